"""What is spoken in a subtitle file: cues without timing, markup, sounds, speakers and adverts."""

from __future__ import annotations

import re

#: A cue's times in every notation met: comma or point, a short arrow, no spaces, an escaped arrow; files may break off in them.
TIMING = re.compile(r"\d\d:\d\d:\d\d(?:[.,:]\d{0,3} ?(?:(?:-{0,2}>|-{1,2}&gt;|→|-{1,2}$).*)?)?$")
STRIP = " \t\ufeff-–—\xa0"
#: Signs that recognition confuses are one sign (fixed values): c for e, t for f, b for h, o for 0, s for 5.
SAME = bytes.maketrans(b"cfh05", b"etbos")
#: Cyrillic letters that look like Latin ones, and those (fixed values).
LOOKALIKES = str.maketrans("АВЕЅІЈКМНОРСТУХаеѕіјорсухкмтһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxkmthdqw")
MISREAD = re.compile("[ÐÑ].")
CYRILLIC = re.compile("[\u0400-\u052f]")
SPACES = re.compile("[\xa0\u2000-\u200a\u202f\u3000]")
#: Thin signs, which stand for one another and for stray marks, are left out, and so is all punctuation (fixed values).
THIN = b"ijl1|" + bytes(c for c in range(128) if not chr(c).isalnum() and not chr(c).isspace() and chr(c) != "|")
TAGS = re.compile(r"<[^<>\n]{1,60}>|\{[^{}\n]{1,60}\}")
SOUNDS = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|♪[^♪]*♪|â™ª.*?â™ª|ÔÖ¬.*?ÔÖ¬|\*[^*\n]+\*|#[^#\n]+#|~[^~\n]+~|[♪♫]")
SUNG = re.compile(r"(?i)\bl[a4] l[a4],? l[a4],? ?(?:l[a4],? ?)*")
SPEAKER = re.compile(r"^[-–— ]*(?:[^\W\d_a-zß-öø-ÿ][^a-zß-öø-ÿ:\s]{2,19} ?:\s+)+(?=[^\n]*[a-zß-öø-ÿ])")
DOMAIN = re.compile(r"(?i)www\.|\bhttps?:|[\w|-]{4,}\.(?:[a-z]{2,8}|[\w|]{6,8})(?![\w.])(?<!\.\.\.)")
CREDIT = re.compile(
    r"(?i)\bre ?sync ?: |\bsync and correct|\bsub ?titles by\b|\bsubt\S{1,6}tulos por\b|\buntertitel ?:|\btraduction ?:|\brelecture ?:|\bencoded by\b|\bdownloaded from\b|\bsous-titres? (?:par|de)\b|\badvertise your (?:product|brand)|\bbecome a vip\b|\bsupport us and\b"
)
#: Characters that a line of plain speech lacks: markup, sounds, labels, sites.
MARKED = re.compile(r"[<{\[(♪♫*#~:]|\w\.\w|â™ª|ÔÖ¬|\b[Ll]a,? la\b")
CREDITS = ("subt", "sync", "relecture", "traduction", "untertitel", "downloaded", "encoded", "sous-t", "advertise", "vip", "support us")


def _reread(m: re.Match) -> str:
    """A Cyrillic letter whose two bytes were read as two letters."""
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


def fold(text: str) -> bytes:
    """Text in signs that survive recognition errors, its white space kept."""
    if not text.isascii():
        if "Ð" in text or "Ñ" in text:
            text = MISREAD.sub(_reread, text)
        if CYRILLIC.search(text):
            text = text.translate(LOOKALIKES)
        if SPACES.search(text):
            text = SPACES.sub(" ", text)
    low = text.lower().encode("ascii", "ignore")
    low = low.replace(b"rn", b"m").replace(b"vv", b"w").replace(b"cl", b"d")
    return low.translate(SAME, THIN)


def is_advert(line: str) -> bool:
    """Whether a line names a site or credits makers of subtitles."""
    if "." in line and DOMAIN.search(line):
        return True
    low = line.lower()
    return any(c in low for c in CREDITS) and bool(CREDIT.search(line))


def timing(line: str) -> bool:
    """Whether a line holds a cue's times, possibly cut off."""
    line = line.strip(" \t\ufeff")
    return line[2:3] == ":" and line[5:6] == ":" and bool(TIMING.match(line))


def _spoken(body: list[str]) -> list[str]:
    text = "\n".join(body)
    if MARKED.search(text):
        text = SOUNDS.sub(" ", TAGS.sub("", text))
        text = SUNG.sub(" ", text) if "la" in text else text
        body = [SPEAKER.sub("", line) if ":" in line else line for line in text.split("\n") if not ("." in line or ":" in line or " " in line) or not is_advert(line)]
    elif " by " in text or " or " in text or " us " in text or " VIP " in text:
        body = [line for line in body if not is_advert(line)]
    return [line for line in (x.strip(STRIP) for x in body) if len(line) > 1 or line.isalnum()]


def _again(line: str, before: list[str]) -> bool:
    """Whether the cue before showed this line, perhaps damaged in one of the two."""
    for other in before:
        if abs(len(other) - len(line)) <= 3 and (other[:4] == line[:4] or other[-4:] == line[-4:]) and len(line) > 8:
            if fold(other).replace(b" ", b"") == fold(line).replace(b" ", b""):
                return True
    return False


def cues(text: str) -> list[list[str]]:
    """Spoken lines of each cue that says anything, in order.

    Lines that name a site or credit makers are adverts. A line that the cue before showed
    already is left out, and so is a cue with no other lines. A text without times is one
    cue for each block of lines.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[list[str]] = []
    bodies: list[list[str]] = [[]]
    body = bodies[0]
    timed = False
    for line in text.split("\n"):
        if not line:
            if not timed and body:
                body = []
                bodies.append(body)
            continue
        if (line[2:3] == ":" or line[0] in " \t\ufeff") and timing(line):
            if body and body[-1].strip(STRIP).isdigit():
                body.pop()
            timed = True
            body = []
            bodies.append(body)
        else:
            body.append(line)
    before: list[str] = []
    for body in bodies:
        if not body:
            continue
        shown = _spoken(body)
        if shown:
            new = [x for x in shown if x not in before and not _again(x, before)] if before else shown
            before = shown
            if new:
                out.append(new)
    return out
