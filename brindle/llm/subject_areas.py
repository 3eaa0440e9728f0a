"""Subject areas of subtitle files, by a distributed latent Dirichlet topic model.

Files are bags of folded words. Topics start from the words of labelled examples, one a
subject and language and one a language for what belongs to no subject, and are fitted to
all files by expectation maximisation: each pass sends the topics to the executors and sums
the words that files ascribe to each topic. The fitted topics are then inspected: a topic
stands for the subject from which most of its leading words come in the examples, or for
none. At last each file's topic proportions are inferred, its words are ascribed to topics by
them, and so is each cue, to the subject that most of its words are ascribed to; a file's
subjects are those with a large enough proportion of its spoken cues.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.subtitles import cues, fold
from brindle.session import spread, written

#: Words with topics of their own: those in most files, at least in so many; all others share BUCKETS slots by their numbers.
MOST_WORDS, LEAST_FILES, BUCKETS = 131_072, 3, 4096
#: Labelled examples that are read at most, of lowest id.
MOST_EXAMPLES = 20_000
#: Files whose words are ascribed together, few enough for a processor's cache.
FILES_AT_ONCE = 200
#: The part of a file below which a topic is dropped from it, and the part of a word that file and corpus must ascribe to one subject.
LEAST_OF_FILE, SPEAKS = 0.05, 0.6
WORDS = "doc_id bigint, terms array<int>, ends array<int>"


class _Codes(dict):
    """Number of each folded word, remembered."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = zlib.crc32(word) & 0x7FFFFFFF
        return n


def encode_cues(text: str, codes: _Codes) -> tuple[list[int], list[int]]:
    """Word numbers of all cues, and where each cue ends among them."""
    lines = [" ".join(c) for c in cues(text)]
    terms: list[int] = []
    ends: list[int] = []
    for words in fold("\n".join(lines)).split(b"\n") if lines else []:
        terms += [codes[w] for w in words.split() if len(w) > 1 and w.isalpha()]
        ends.append(len(terms))
    return terms, ends


def cue_words(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, terms, ends): the words of each file's spoken cues as numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            terms, ends, t_off, e_off = [], [], [0], [0]
            for text in b.column(1):
                t, e = encode_cues(text.as_py() or "", codes)
                terms += t
                ends += e
                t_off.append(len(terms))
                e_off.append(len(ends))
            make = lambda off, x: pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), make(t_off, terms), make(e_off, ends)], names=["doc_id", "terms", "ends"])

    return spread(documents.select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(work, WORDS)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column without nulls."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), lengths


def _slots(vocabulary: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The slot of each word number."""
    at = np.searchsorted(vocabulary, values)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == values if len(vocabulary) else np.zeros(len(values), bool)
    return np.where(known, at, len(vocabulary) + values % BUCKETS)


def _counts(vocabulary: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(file, slot, count) of a batch's words, sorted by file, and which of these entries each word belongs to."""
    rows, size = np.repeat(np.arange(len(lengths)), lengths), len(vocabulary) + BUCKETS
    keys, entry, n = np.unique(rows * np.int64(size) + _slots(vocabulary, values), return_inverse=True, return_counts=True)
    return keys // size, keys % size, n.astype(np.float64), entry


def e_step(rows: np.ndarray, cols: np.ndarray, n: np.ndarray, files: int, phi: np.ndarray, prior: np.ndarray, rounds: int, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Share of each counted word that its file ascribes to each topic (entries, topics), the files' topic proportions,
    and the log-likelihood of the words.

    A topic that stays below ``least`` of a file is dropped from it before the last round, so
    that no file takes in a subject for the sake of a stray word.
    """
    word = phi.T.astype(np.float32)[cols]
    most = np.maximum(word.max(axis=1, keepdims=True), np.float32(1e-30))
    word /= most
    prior = prior.astype(np.float32)
    theta = np.tile(prior / prior.sum(), (files, 1))
    n = n.astype(np.float32)[:, None]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    share, likelihood = word, 0.0
    for r in range(rounds):
        if r == rounds - 1:
            theta[(theta < least) & (theta < theta.max(axis=1, keepdims=True))] = 0
        share = theta[rows]
        share *= word
        total = np.maximum(share.sum(axis=1, keepdims=True), np.float32(1e-30))
        share /= total
        if r == rounds - 1:
            likelihood = float((n * np.log(total * most)).sum(dtype=np.float64))
        if len(starts):
            theta[:] = prior
            theta[rows[starts]] += np.add.reduceat(share * n, starts, axis=0)
            theta /= theta.sum(axis=1, keepdims=True)
    return share, theta, likelihood


@dataclass
class Model:
    """Words with slots of their own (sorted numbers), the subject names, the topics (topics, slots) and their prior, what
    each topic stands for (-1: none), the log-likelihood of all words in each pass, and the part of each slot's words that
    the corpus ascribes to each subject (slots, areas)."""

    vocabulary: np.ndarray
    areas: list[str]
    phi: np.ndarray
    prior: np.ndarray
    stands_for: np.ndarray
    likelihoods: list[float]
    weight: np.ndarray


def _document_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words with slots of their own, and in how many files the words of each slot occur."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            values, lengths = _flat(b.column(0))
            rows = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
            once = np.unique((rows << 31) | values) & 0x7FFFFFFF
            both, back = np.unique(np.concatenate([held, once]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([n, np.ones(len(once))]), minlength=len(both)).astype(np.int64)
            held = both
            if len(held) > 2_000_000:  # hand over and start again; sums don't mind
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], names=["term", "n"])
                held, n = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], names=["term", "n"])

    counted = written(words.select("terms").mapInArrow(work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "word-counts")
    top = counted.filter(F.col("n") >= LEAST_FILES).orderBy(F.desc("n"), "term").limit(MOST_WORDS).toArrow()
    term, n = top["term"].to_numpy(), top["n"].to_numpy()
    after = F.col("n") < LEAST_FILES
    if len(term) == MOST_WORDS:
        after = (F.col("n") < int(n[-1])) | ((F.col("n") == int(n[-1])) & (F.col("term") > int(term[-1])))
    shared = counted.filter(after).groupBy((F.col("term") % BUCKETS).alias("b")).agg(F.sum("n").alias("n")).toArrow()
    rest = np.zeros(BUCKETS)
    rest[shared["b"].to_numpy()] = shared["n"].to_numpy()
    order = np.argsort(term)
    return term[order], np.concatenate([n[order], rest])


def fit(words: DataFrame, examples: list[tuple[str, str, str | None]], passes: int = 3, rounds: int = 5, leading: int = 40, tolerance: float = 2e-3) -> Model:
    """Fit topics to all files, from labelled (area, text, lang) examples, and inspect them. Passes end early once the
    log-likelihood grows by less than tolerance of itself."""
    areas = sorted({a for a, _, _ in examples if a})
    langs = sorted({x for _, _, x in examples if x}) or [""]
    vocabulary, files = _document_counts(words)
    v = len(files)
    if not len(vocabulary) or not areas:
        return Model(vocabulary, areas, np.zeros((0, v)), np.empty(0), np.empty(0, np.int64), [], np.zeros((v, len(areas))))
    codes = _Codes()
    by_area, by_lang = np.zeros((len(areas), v)), np.zeros((len(langs), v))
    for area, text, lang in examples:
        for w in fold(text or "").split():
            at = int(_slots(vocabulary, np.array([codes[w]]))[0])
            if area and at < len(vocabulary):
                by_area[areas.index(area), at] += 1
                by_lang[:, at] += 1 / len(langs) if not lang else np.array([x == lang for x in langs])
    # a word starts in the subject that uses it more than the others, and the more evenly they use it, in its language's own topic
    p = (by_area + 0.02) / (by_area + 0.02).sum(axis=0)
    even = -(p * np.log(p)).sum(axis=0) / np.log(max(2, len(areas)))
    seen = by_area.sum(axis=0)
    even = np.where(seen > 0, np.minimum(1, even + 0.2 / np.maximum(seen, 1)), 0.9)
    q = (by_lang + 0.02) / (by_lang + 0.02).sum(axis=0)
    topics = np.concatenate([(p * (1 - even))[:, None] * q[None], (q * even)[None]]).reshape(-1, v) * files  # subjects by languages, then none by languages
    prior = np.concatenate([np.full(len(areas) * len(langs), 0.05), np.full(len(langs), 0.3)])
    k, likelihoods = len(topics), []
    for _ in range(passes):
        topics, likelihood = _pass(words, vocabulary, _phi(topics), prior, rounds)
        likelihoods.append(likelihood)
        if len(likelihoods) > 1 and likelihood - likelihoods[-2] <= tolerance * abs(likelihood):
            break
    phi = _phi(topics)
    # inspection: the words that lead a topic by lift, and whose they are in the examples
    lift = phi / np.maximum(files / max(1, files.sum()), 1e-12)
    stands_for = np.full(k, -1)
    for z in range(k):
        share = topics[z] / np.maximum(topics.sum(axis=0), 1e-9)
        lead = np.argsort(-np.where(share > 0.5, np.log(lift[z]) * np.sqrt(topics[z]), -np.inf), kind="stable")[:leading]
        lead = lead[share[lead] > 0.5]
        lead = lead[seen[lead] > 0]
        of = (p * (1 - even))[:, lead].sum(axis=1)
        if of.max() > 0.3 * max(1, len(lead)):
            stands_for[z] = int(of.argmax())
    subject = np.zeros((k, len(areas)))
    subject[np.flatnonzero(stands_for >= 0), stands_for[stands_for >= 0]] = 1
    weight = (topics / np.maximum(topics.sum(axis=0), 1e-9)).T @ subject
    return Model(vocabulary, areas, phi.astype(np.float32), prior, stands_for, likelihoods, weight.astype(np.float32))


def _phi(topics: np.ndarray) -> np.ndarray:
    return (topics + 0.01) / (topics + 0.01).sum(axis=1, keepdims=True)


def _pass(words: DataFrame, vocabulary: np.ndarray, phi: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Occurrences of each slot's words that all files ascribe to each topic (topics, slots), and the log-likelihood."""
    k, v = phi.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, likelihood = np.zeros((v, k)), 0.0
        for b in batches:
            for s in range(0, b.num_rows, FILES_AT_ONCE):
                values, lengths = _flat(b.slice(s, FILES_AT_ONCE).column(0))
                rows, cols, n, _ = _counts(vocabulary, values, lengths)
                share, _, more = e_step(rows, cols, n, len(lengths), phi, prior, rounds, LEAST_OF_FILE)
                share, likelihood = share * n[:, None], likelihood + more
                order = np.argsort(cols, kind="stable")
                starts = np.flatnonzero(np.diff(cols[order], prepend=-1))
                if len(starts):
                    total[cols[order][starts]] += np.add.reduceat(share[order], starts, axis=0)
        some = np.flatnonzero(total.sum(axis=1))
        sums = np.concatenate([total[some].ravel(), [likelihood], np.zeros(k - 1)])  # the likelihood as a slot beyond the last
        lists = pa.ListArray.from_arrays(np.arange(len(some) + 2, dtype=np.int32) * k, pa.array(sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, v)), lists], names=["word", "s"])

    got = words.select("terms").mapInArrow(work, "word bigint, s array<double>").groupBy("word").agg(*[F.sum(F.col("s")[z]).alias(f"s{z}") for z in range(k)]).toArrow()
    out = np.zeros((k, v + 1))
    at = got["word"].to_numpy()
    for z in range(k):
        out[z, at] = got[f"s{z}"].to_numpy()
    return out[:, :v], float(out[0, v])


def cue_subjects(weight: np.ndarray, ends: np.ndarray, clear: float, also: float) -> tuple[np.ndarray, np.ndarray]:
    """(cue, area) pairs: what each cue is about, from what its words are ascribed to (words, areas): the subject with most
    words, if they come to ``clear``, and a further one whose words come to ``also``."""
    sums = np.concatenate([np.zeros((1, weight.shape[1])), np.cumsum(weight, axis=0, dtype=np.float64)])
    score = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
    best = score.argmax(axis=1)
    about = score >= also
    lead = score[np.arange(len(best)), best] >= clear
    about[np.arange(len(best))[lead], best[lead]] = True
    return np.nonzero(about)


def file_subjects(model: Model, terms: np.ndarray, t_len: np.ndarray, ends: np.ndarray, e_len: np.ndarray, share: float, clear: float, also: float, rounds: int, least: float) -> tuple[np.ndarray, ...]:
    """(file, area, cues about it) of a few files: their words lie in terms, their cues end among their words at ends."""
    areas = len(model.areas)
    rows, cols, n, entry = _counts(model.vocabulary, terms, t_len)
    ascribed, _, _ = e_step(rows, cols, n, len(t_len), model.phi, model.prior, rounds, least)
    some = np.flatnonzero(model.stands_for >= 0)
    subject = np.zeros((len(model.stands_for), areas), np.float32)
    subject[some, model.stands_for[some]] = 1
    # what both the file, by its topic proportions, and the corpus ascribe to the subject
    weight = np.minimum(ascribed @ subject, model.weight[cols])[entry]
    weight = np.where(weight.max(axis=1, keepdims=True) >= SPEAKS, weight, 0)
    doc = np.repeat(np.arange(len(t_len)), e_len)
    cue, area = cue_subjects(weight, ends + (np.cumsum(t_len) - t_len)[doc], clear, also)
    keys, count = np.unique(doc[cue] * areas + area, return_counts=True)
    enough = count >= share * e_len[keys // areas] - 1e-9
    return keys[enough] // areas, keys[enough] % areas, count[enough]


def areas_of(words: DataFrame, model: Model, share: float = 0.2, clear: float = 0.5, also: float = 0.85, rounds: int = 5, least: float = LEAST_OF_FILE) -> DataFrame:
    """(doc_id, area, cues, spoken): the subjects that at least ``share`` of a file's spoken cues are about."""
    names = np.array(model.areas, dtype=object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, FILES_AT_ONCE):
                part = b.slice(s, FILES_AT_ONCE)
                (terms, t_len), (ends, e_len) = _flat(part.column(1)), _flat(part.column(2))
                if not len(ends) or not len(terms) or not len(model.phi):
                    continue
                d, a, n = file_subjects(model, terms, t_len, ends, e_len, share, clear, also, rounds, least)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(d)), pa.array(names[a], pa.string()), pa.array(n.astype(np.int32)), pa.array(e_len[d].astype(np.int32))],
                    names=["doc_id", "area", "cues", "spoken"],
                )

    return words.mapInArrow(work, "doc_id bigint, area string, cues int, spoken int")


def read_examples(examples: DataFrame) -> list[tuple[str, str, str | None]]:
    """(area, text, lang) of the labelled examples, MOST_EXAMPLES of lowest id at most."""
    rows = examples.filter("area IS NOT NULL AND text IS NOT NULL").orderBy("example_id").limit(MOST_EXAMPLES)
    return [(r["area"], r["text"], r["lang"]) for r in rows.select("area", "text", "lang").collect()]


def subjects(documents: DataFrame, examples: DataFrame, doc_col: str = "doc_id", text_col: str = "text", share: float = 0.2, passes: int = 3) -> DataFrame:
    """(doc_id, area, cues, spoken): each file's subject areas, with the cues about them and all its spoken cues.

    The words of all files are written once to the shared folder; vocabulary, topics and
    proportions cover all files. A task sends one row a known word and pass; nothing is
    gathered by file, so long or repeated files cost what they hold. The labelled examples
    are read up to MOST_EXAMPLES; some may be wrong.

    A null, empty or unspoken text has no subject; neither has any file without examples.
    Repeated rows each have their subjects. A null id is reported as it is.
    """
    words = written(cue_words(documents, doc_col, text_col), "cue-words")
    return areas_of(words, fit(words, read_examples(examples), passes), share)
