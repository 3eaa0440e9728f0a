"""Loading delimited ad lines and setting the unsound ones aside with their reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One record under RFC 4180: every field is either quoted as a whole or free of quotes.
SOUND = r'(?s)\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*\z'
QUOTED = r'"(?:[^"]|"")*"'
TRIPLES = r"\A *(?:[^ :]*:[^ :]*:[^ :]*(?: +[^ :]*:[^ :]*:[^ :]*)*)? *\z"
ROW_ID, LABEL = r"\A[0-9]{1,18}\z", r"\A[01]\z"
FIELD, FID = r"\A0*(?:[0-9]|[123][0-9])\z", r"\A0*[0-9]{1,19}\z"
VALUE = r"\A-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
MAX_FID = 9223372036854775807
#: Characters handed to the CSV parser at a time.
BLOCK = 32 << 20

FEATURES = pa.list_(pa.struct([("field", pa.int32()), ("fid", pa.int64()), ("val", pa.float64())]))
LOADED = "line_id bigint, reason string, cell string, row_id bigint, label int, placement string, features array<struct<field:int,fid:bigint,val:double>>"


def _match(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(values, pattern), False).to_numpy(zero_copy_only=False)


def _structure(lines: pa.Array, at: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Parse quoting-sound lines: positions that have four fields, and those fields as strings."""
    rejected: list[int] = []

    def invalid(row) -> str:
        rejected.append(int(row.text.split(",", 1)[0]))
        return "skip"

    numbered = pc.binary_join_element_wise(pa.array(at.astype(str)), lines, ",")
    data = "\n".join(numbered.to_pylist()).encode() + b"\n"
    parsed = csv.read_csv(
        pa.BufferReader(data),
        read_options=csv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=["at", "0", "1", "2", "3"]),
        parse_options=csv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=csv.ConvertOptions(
            column_types={"at": pa.int64(), **{str(i): pa.string() for i in range(4)}}, strings_can_be_null=False, null_values=[]
        ),
    ).combine_chunks()
    got = parsed["at"].to_numpy()
    assert len(got) + len(rejected) == len(at), "the parser lost lines"
    return got, [parsed[str(i)].combine_chunks() if parsed.num_rows else pa.array([], pa.string()) for i in range(4)]


def _split_loose(line: str) -> list[str]:
    """Fields of a quoting-sound line with line breaks outside quotes, which a CSV parser would take for row ends."""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while line[j] != '"' or line[j + 1 : j + 2] == '"':
                j += 1 + (line[j] == '"')
            fields.append(line[i + 1 : j].replace('""', '"'))
            j += 1
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            fields.append(line[i:j])
        if j >= len(line):
            return fields
        i = j + 1


def _parse(ids: pa.Array, lines: pa.Array) -> pa.RecordBatch:
    n = len(lines)
    reason = np.full(n, None, dtype=object)
    cell = np.full(n, None, dtype=object)
    lines = pc.fill_null(lines.cast(pa.string()), "")
    lines = pc.replace_substring_regex(lines, r"\r\z", "")
    sound = _match(lines, SOUND)
    reason[~sound] = "quoting"
    bare = pc.replace_substring_regex(lines, QUOTED, "")
    loose = sound & _match(bare, r"[\r\n]")

    tidy = np.flatnonzero(sound & ~loose)
    at, fields = _structure(lines.take(pa.array(tidy)), tidy) if len(tidy) else (tidy, [pa.array([], pa.string())] * 4)
    extra = [(i, f) for i in np.flatnonzero(loose) if len(f := _split_loose(lines[int(i)].as_py())) == 4]
    if extra:
        at = np.concatenate([at, np.array([i for i, _ in extra], dtype=at.dtype)])
        fields = [pa.concat_arrays([a, pa.array([f[c] for _, f in extra], pa.string())]) for c, a in enumerate(fields)]
    whole = np.zeros(n, dtype=bool)
    whole[at] = True
    reason[sound & ~whole] = "column_count"

    shaped = _match(fields[2], TRIPLES)
    reason[at[~shaped]] = "column_count"
    cell[at[~shaped]] = "features"
    keep = pa.array(shaped)
    at, (row, label, feats, place) = at[shaped], [f.filter(keep) for f in fields]

    # cells, the first failing one in column order is named
    trimmed = pc.utf8_trim(feats, " ")
    some = pc.greater(pc.utf8_length(trimmed), 0).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern_regex(trimmed, " +")
    tokens, parent = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    real = pc.greater(pc.utf8_length(tokens), 0)
    tokens, parent = tokens.filter(real), parent[real.to_numpy(zero_copy_only=False)]
    cut = pc.extract_regex(tokens, r"\A(?P<field>[^:]*):(?P<fid>[^:]*):(?P<val>[^:]*)\z")
    f_field, f_fid, f_val = (pc.struct_field(cut, i) for i in range(3))
    ok_field, ok_fid, ok_val = _match(f_field, FIELD), _match(f_fid, FID), _match(f_val, VALUE)

    def cast(values: pa.Array, good: np.ndarray, kind: pa.DataType) -> np.ndarray:
        return pc.if_else(pa.array(good), values, "0").cast(kind).to_numpy(zero_copy_only=False)

    long = cast(pc.if_else(pc.equal(pc.ascii_ltrim(f_fid, "0"), ""), "0", pc.ascii_ltrim(f_fid, "0")), ok_fid, pa.uint64())
    ok_fid &= long <= MAX_FID
    number = np.array([float(v) for v in pc.if_else(pa.array(ok_val), f_val, "0").to_pylist()], dtype=np.float64)
    ok_val &= np.isfinite(number)
    bad = {}
    for name, good in (("field", ok_field), ("fid", ok_fid), ("val", ok_val)):
        bad[name] = np.zeros(len(at), dtype=bool)
        bad[name][parent[~good]] = True
    checks = [("row_id", ~_match(row, ROW_ID)), ("label", ~_match(label, LABEL)), ("features", ~some), *bad.items()]
    failing = np.zeros(len(at), dtype=bool)
    for name, fails in checks:
        new = fails & ~failing
        cell[at[new]] = name
        failing |= fails
    reason[at[failing]] = "bad_value"

    # the sound rows
    fine = ~failing
    rows = cast(row, fine, pa.int64())
    labels = cast(label, fine, pa.int32())
    held = fine[parent]
    counts = np.bincount(parent[held], minlength=len(at))
    ints = pc.if_else(pa.array(ok_field), f_field, "0").cast(pa.int32()).to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    full = lambda fill, dtype: np.full(n, fill, dtype=dtype)
    all_rows, all_labels, none = full(0, np.int64), full(0, np.int32), full(True, bool)
    all_rows[at], all_labels[at], none[at] = rows, labels, failing
    places = full(None, object)
    places[at] = np.array(place.to_pylist(), dtype=object)
    places[none] = None
    sizes = full(0, np.int64)
    sizes[at] = np.where(fine, counts, 0)
    # tokens follow the order of `at`; bring them into line order
    rank = np.empty(len(at), dtype=np.int64)
    rank[order] = np.arange(len(at))
    sel = np.flatnonzero(held)
    sel = sel[np.argsort(rank[parent[sel]], kind="stable")]
    items = pa.StructArray.from_arrays(
        [pa.array(ints[sel], pa.int32()), pa.array(long[sel].astype(np.int64), pa.int64()), pa.array(number[sel], pa.float64())], ["field", "fid", "val"]
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(none, False))
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(reason, pa.string()),
            pa.array(cell, pa.string()),
            pa.array(all_rows, mask=none),
            pa.array(all_labels, mask=none),
            pa.array(places, pa.string()),
            pa.ListArray.from_arrays(offsets, items).cast(FEATURES),
        ],
        names=["line_id", "reason", "cell", "row_id", "label", "placement", "features"],
    )


def load_ad_lines(lines: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """One row a line: the parsed record, or the reason why there is none and the failing cell.

    Quoting is checked by a linear-time pattern, column counts by the CSV parser's
    invalid-row callback, then fields read as strings are cast as vectors. Reasons, the
    first that holds: quoting, column_count, bad_value (see TESTDATA.md, problem 5). Rows
    are parsed where they are read; nothing is shuffled.

    A null line is an empty line and fails with column_count. Repeated lines each give
    their row, null ids stay null, an empty table gives none. Lines may be of any length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, text = 0, b.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(text) else []
            while start < b.num_rows:  # blocks, so that long lines never meet in one buffer
                base = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, base + BLOCK, side="right")))
                part = b.slice(start, end - start)
                yield _parse(part.column(0), part.column(1))
                start = end

    return lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(line_col).alias("line")).mapInArrow(work, LOADED)


def rejects(loaded: DataFrame) -> DataFrame:
    """(line_id, reason, cell) of the unsound lines."""
    return loaded.filter(F.col("reason").isNotNull()).select("line_id", "reason", "cell")


def triples(loaded: DataFrame) -> DataFrame:
    """(line_id, row_id, label, placement, pos, field, fid, val) of the sound lines."""
    sound = loaded.filter(F.col("reason").isNull())
    return sound.select("line_id", "row_id", "label", "placement", F.posexplode("features").alias("pos", "f")).select(
        "line_id", "row_id", "label", "placement", "pos", "f.field", "f.fid", "f.val"
    )
