"""Subtitle parsing, leaked passages and subject areas on small made-up files."""

import random

import pytest

from brindle.llm import eval_leaks, subject_areas
from brindle.llm.subtitles import cues, fold

ITEM = "Nobody in Denwen lends a rilpirs before Vashkelqua has counted the 17 kelmar stored above the barrel. Zolpir has 10 bells, yet just 25 of them frighten the copper gimbas."
OTHER = "Nobody in Tovkel lends a stenuls before Marbri has counted the 44 hulzol stored above the lantern. Quasten has 83 bells, yet just 31 of them frighten the amber bridals."
ITEMS = [(1, ITEM), (2, OTHER), (3, "Rank these by weight: the velvet denfals from Vashril, the well of Falzol, and 49 wet denwen.")]


def srt(lines, arrow=" --> ", end="\n"):
    at = lambda i: f"{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}"
    return end.join(f"{i + 1}{end}{at(i)},000{arrow}{at(i)},900{end}{x}{end}" for i, x in enumerate(lines))


def chunks(text, n=6):
    w = text.split()
    return [" ".join(w[i : i + n]) for i in range(0, len(w), n)]


@pytest.mark.parametrize("arrow", [" --> ", "-->", " -> ", " --&gt; "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cues_keep_what_is_spoken(arrow, end):
    text = srt(["Hello <i>the</i>re.", "[door slams]", "MESSA: It is 10:30.", "- ONE\n- (sighs) Two", "Sync and corrections by X", "~ cuebarn.example ~", "{\\an8}Three ♪ la la, la la la ♪"], arrow, end)
    assert [[x.strip() for x in c] for c in cues(text)] == [["Hello there."], ["It is 10:30."], ["ONE", "Two"], ["Three"]]


def test_a_line_shown_again_counts_once():
    assert cues(srt(["one two three", "one two three\nfour five", "f0ur five\nsix"])) == [["one two three"], ["four five"], ["f0ur five", "six"]] or cues(
        srt(["one two three", "one two three\nfour five", "f0ur five\nsix"])
    ) == [["one two three"], ["four five"], ["six"]]
    assert cues(srt(["alpha beta gamma", "aIpha beta gamma\ndelta"])) == [["alpha beta gamma"], ["delta"]]


def test_cues_of_hardly_anything():
    assert cues("") == [] and cues("\n\n\r\n") == [] and cues("1\n00:00:01,000 --> 00:0") == []
    assert cues("plain text\nwithout times") == [["plain text", "without times"]]


def test_folding_undoes_recognition_errors():
    for a, b in (("counted", "c0unfed"), ("kelmar", "kelrnar"), ("barrel", "barreI"), ("wind", "vvind"), ("bell", "belI"), ("gardien", "gаrdіеn"), ("falfals", "fÐ°lfÐ°ls"), ("ESPAÑA", "ESPAÑA")):
        assert fold(a) == fold(b)
    assert fold("hulzol") != fold("hulba") and fold("Denwen") != fold("Denden")


def found(spark, docs, items=ITEMS, **k):
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["item_id"], r["doc_id"], r["kind"]) for r in eval_leaks.leaks(d, e, **k).collect()}


def test_leaks(spark):
    w = ITEM.split()
    damaged = "Nobodyin Denwen Iends a ril pirs bef0re Vashkelqua has <b>co</b>unted the 17 kelrnar stored abovc tlie barreI."
    swapped = " ".join(w).replace("17", "18").replace("just 25", "just 24").replace("stored", "hidden").replace("lends", "sells").replace("Zolpir", "Tovmar")
    docs = [
        (1, srt(chunks(ITEM))),
        (2, srt(chunks(" ".join(w[:12]), 3))),
        (3, srt(chunks(" ".join(w[:11])))),
        (4, srt(chunks(damaged.upper()))),
        (5, srt(chunks(swapped))),
        (6, srt(["Good morning.", *[x for c in chunks(ITEM) for x in (c, "[sighs]", "~ cuebarn.example ~")]])),
        (7, srt(["Who ate the last one?", "Nothing. Forget I said it."])),
        (8, None),
        (9, ""),
        (1, srt(chunks(ITEM))),
        (10, srt([f"{a}\n{b}" for a, b in zip(chunks(ITEM), chunks(ITEM)[1:], strict=False)])),
        (11, srt(chunks("filler words " * 30_000 + ITEM, 8)[-2000:])),
    ]
    got = found(spark, docs)
    assert {(i, d) for i, d, k in got if k == "verbatim"} == {(1, d) for d in (1, 2, 4, 6, 10, 11)}


def test_a_passage_with_few_names_is_followed(spark):
    # two short or common names only: nothing in the raw file tells that the document speaks the item
    plain = "Zolpir has 10 bells, yet just 25 of them frighten the copper gimbas."
    slow = srt([w for w in " ".join(ITEM.split()[3:16]).split()])
    assert eval_leaks.find(eval_leaks.build_index(ITEMS), slow, 12, 24) != []
    assert found(spark, [(1, srt(chunks(plain))), (2, slow)]) == {(1, 1, "verbatim"), (1, 2, "verbatim")}


def _damaged(words, bad, turn):
    """Words with those at bad damaged in a character or, in turn, run together with the next or cut in two."""
    out, k = [], 0
    while k < len(words):
        w = words[k]
        if k not in bad or len(w) < 4:
            out.append(w)
        elif (k + turn) % 3 == 0 and k + 1 < len(words):
            out.append(w.strip(".,:") + words[k + 1])
            k += 1
        elif (k + turn) % 3 == 1:
            out += [w[:2], w[2:]]
        else:
            out.append(w[:2] + "?" + w[3:])
        k += 1
    return " ".join(out)


def test_every_followed_run_is_seeded():
    """However the words of a passage are damaged, find() follows it if any start would."""
    ix = eval_leaks.build_index(ITEMS, 12)
    missed, whole = [], 0
    for n, item in enumerate(t for _, t in ITEMS):
        w = item.split()
        for p in range(len(w) - 11):
            for turn, bad in enumerate(({2, 5}, {3, 4, 8}, {1, 3, 5, 7, 9}, set(range(0, 12, 2)), set(range(12)))):
                text = _damaged(w[p : p + 12], bad, turn)
                words = text.split()
                toks, at = eval_leaks.tokens(words)
                passage = eval_leaks.Passage(ix, n, words, toks, at)
                runs = [
                    passage.run(i, j, a, b)[:2]
                    for i in range(len(ix.toks[n]))
                    for j in range(len(toks))
                    for a, b in ((1, 1), *((1, 2), (2, 1), (2, 2), (1, 3), (3, 1)))
                    if (passage.same(i, j) if (a, b) == (1, 1) else passage.spaced(i, j, a, b))
                ]
                want = any(ix.at[n][hi - 1] - ix.at[n][lo] + 1 >= 12 for lo, hi in runs)
                got = any(m == n and kind == "verbatim" for m, kind, *_ in eval_leaks.find(ix, srt([text]), 12, 24))
                whole += want
                if want and not got:
                    missed.append(text)
    assert whole > 100 and missed == []


def test_an_item_asked_again_is_told_apart(spark):
    other = OTHER.replace("lantern", "barrel").replace("amber", "copper").replace("stenuls", "rilpirs")
    assert found(spark, [(1, srt(chunks(other)))], [(1, ITEM)], asked_again=16) == {(1, 1, "asked again")}
    # one value that stands for two of the item's breaks the template
    assert found(spark, [(1, srt(chunks(other.replace("Marbri", "Tovkel"))))], [(1, ITEM)], asked_again=16) == set()
    assert found(spark, [(1, srt(chunks(ITEM)))], [(1, ITEM)]) == {(1, 1, "verbatim")}


def test_leaks_of_nothing(spark):
    assert found(spark, []) == set() and found(spark, [(1, srt(chunks(ITEM)))], [(None, ITEM), (2, ""), (3, None)]) == set()


AREAS = {
    "music": ["We tune the guitar", "The choir sings a melody", "Conduct the orchestra", "The violin and the drums", "Another melody for the choir", "Drums and guitar"],
    "law": ["The judge heard the witness", "Sign the contract", "The jury reached a verdict", "Appeal the verdict", "A witness for the jury", "The judge read the contract"],
}
TALK = ["Come on we are late", "What a beautiful morning", "Please do not go", "I was only gone a minute", "Did you hear that", "She never called me back"]


def area_frames(spark, docs):
    ex = [(i, a, "en", f"{x}. {TALK[i % 6]}.") for i, (a, x) in enumerate((a, x) for a, xs in AREAS.items() for x in xs)]
    return spark.createDataFrame([(i, t) for i, t in docs], "doc_id bigint, text string"), spark.createDataFrame(ex, "example_id bigint, area string, lang string, text string")


def test_areas(spark):
    docs = []
    for i in range(60):
        m, n = ("music", "law")[i % 2], i % 3
        lines = [AREAS[m][(i + j) % 6] + "." for j in range(4)] + ([AREAS["law" if m == "music" else "music"][j] + "." for j in range(3)] if n == 0 else []) + [TALK[(i + j) % 6] + "." for j in range(4)]
        docs.append((i, srt([*lines, "[door slams]", "Downloaded from www.cuebarn.example"])))
    docs += [(100, srt(TALK)), (101, None), (102, ""), (103, srt(["[sighs]"])), (100, srt(TALK))]
    d, ex = area_frames(spark, docs)
    got = {(r["doc_id"], r["area"]): (r["cues"], r["spoken"]) for r in subject_areas.subjects(d, ex).collect()}
    want = set()
    for i in range(60):
        m = ("music", "law")[i % 2]
        want |= {(i, m)} | ({(i, "law" if m == "music" else "music")} if i % 3 == 0 else set())
    assert set(got) == want
    assert got[1, "law"] == (4, 8) and got[0, "music"] == (4, 11) and got[0, "law"] == (3, 11)


def test_every_word_has_a_slot(spark, monkeypatch):
    """With room for few words the others share slots, and subjects are still found."""
    monkeypatch.setattr(subject_areas, "MOST_WORDS", 60)
    docs = [(i, srt([AREAS[("music", "law")[i % 2]][(i + j) % 6] + "." for j in range(5)] + [TALK[(i + j) % 6] + "." for j in range(3)])) for i in range(60)]
    d, ex = area_frames(spark, docs)
    words = subject_areas.cue_words(d)
    model = subject_areas.fit(words, subject_areas.read_examples(ex))
    assert len(model.vocabulary) <= 60 and model.phi.shape[1] == len(model.vocabulary) + subject_areas.BUCKETS
    assert len(model.likelihoods) > 1 and model.likelihoods[-1] >= model.likelihoods[0]
    assert {(r["doc_id"], r["area"]) for r in subject_areas.areas_of(words, model).collect()} == {(i, ("music", "law")[i % 2]) for i in range(60)}


def test_areas_recall_on_longer_made_up_files(spark):
    rng = random.Random(4)
    docs, want = [], set()
    for i in range(150):
        a, b = rng.sample(["music", "law", None], 2)
        n = rng.randint(10, 40)
        lines = [rng.choice(AREAS[x] if x else TALK) + "." for x in rng.choices([a, b], [3, 2], k=n)]
        shares = {x: sum(line[:-1] in AREAS[x] for line in lines) / n for x in AREAS}
        want |= {(i, x) for x, s in shares.items() if s >= 0.2}
        docs.append((i, srt(lines)))
    got = {(r["doc_id"], r["area"]) for r in subject_areas.subjects(*area_frames(spark, docs)).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_areas_of_nothing(spark):
    d, ex = area_frames(spark, [])
    assert subject_areas.subjects(d, ex).count() == 0
    d, ex = area_frames(spark, [(1, srt(TALK)), (None, None)])
    assert subject_areas.subjects(d, ex).count() == 0
    assert subject_areas.subjects(d, ex.limit(0)).count() == 0
