"""Fuzzy line dedup: one line of each group of similar lines stays.

Lines are the runs between line feeds, without the white space around them and with
A-Z lower-cased; a line's set are its distinct eight-character shingles (a shorter
line is one shingle).  Lines are linked at a Jaccard similarity of 0.8 by the engine
of `set_links`: 16 bands of four values of a min-max signature miss a pair at 0.8
with probability 2e-4 and at 0.9 with 1e-7; the buckets that remain open are settled
exactly.  Equal lines are one item, found by hash, so a line that stands in a third
of all documents is one set.  Of each component the first occurrence, by document id
and place, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitstrata.llm import kernels as K
from bitstrata.llm import scratch, sketches
from bitstrata.llm.names import col, fresh, schema_of
from bitstrata.llm.set_links import SLICE, Places, Wanted, linked, moved, places_of, standing

SHINGLE, N_PERM, BAND_ROWS = 8, 32, 4
LINK_NUM, LINK_DEN = 80, 100
#: Line hashes that a task remembers having sent.
MEMO = 1_000_000
#: Bits of the first filter for each line that goes, over those of `bits_for`.
MORE_BITS = 3


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text, number within the text) of the lines, but for some empty ones at a text's end."""
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, "right") - 1
    before = np.searchsorted(feeds, starts)
    number = before - np.searchsorted(feeds, offsets[:-1])[row]
    return starts, np.minimum(np.concatenate([feeds, [len(data)]])[before], offsets[row + 1]), row, number


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text, number within the text) of the lines that are not blank."""
    starts, ends, row, number = lines_of(data, offsets)
    blank = K.is_space(data)
    for _ in range(8):  # most lines have little white space around them
        starts = starts + ((starts < ends) & blank[np.minimum(starts, len(data) - 1)])
        ends = ends - ((starts < ends) & blank[ends - 1])
    live = starts < ends
    starts, ends, row, number = starts[live], ends[live], row[live], number[live]
    if (blank[starts] | blank[ends - 1]).any():
        solid = np.flatnonzero(~blank)
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        live = a < b
        starts, ends, row, number = solid[a[live]], solid[b[live] - 1] + 1, row[live], number[live]
    return starts, ends, row, number


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of spans that don't overlap: every second one of the stretches that their bounds part."""
    order = np.argsort(starts)
    off = np.stack([starts[order], ends[order]], 1).ravel().astype(np.int32)
    at = np.empty(len(order), np.int64)
    at[order] = 2 * np.arange(len(order))
    if not len(off):
        return pa.array([], pa.string())
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))]).take(pa.array(at))


def spots(owner: np.ndarray, number: np.ndarray) -> np.ndarray:
    """An integer for a line's document and number; two lines may share one."""
    return K.mix64(K.mix64(owner.view(np.uint64)) + number.astype(np.uint64)).view(np.int64)


def distinct_lines(batches: Iterator[pa.RecordBatch], wanted: Wanted = None) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, Places | None]]:
    """(hash, line, spot) of the lines of a task that are wanted, each about once; and where all
    lines stand, as (hash, line's number, document), where all are wanted."""
    sent: set[int] = set()
    for batch in batches:
        owners = batch.column(0).to_numpy()
        for i, j, data, offsets in K.pieces(batch.column(1), SLICE if wanted is None else K.SLICE_BYTES):
            if wanted is not None:  # what is not wanted is not looked at
                starts, ends, row, number = lines_of(data, offsets)
                spot = spots(owners[i:j][row], number)
                at = np.flatnonzero(wanted(spot))
                if not len(at):
                    continue
                data, offsets = K.utf8(_gather(data, starts[at], ends[at]))
                low = K.lower(data)
                starts, ends, row, _ = line_spans(low, offsets)
                if len(starts):
                    yield pa.array(K.span_hashes(low, starts, ends).view(np.int64)), _gather(low, starts, ends), pa.array(spot[at[row]]), None
                continue
            low = K.lower(data)
            starts, ends, row, number = line_spans(low, offsets)
            every = K.span_hashes(low, starts, ends)
            hashes, where = np.unique(every, return_index=True)
            fresh = np.array([h not in sent for h in hashes.tolist()], bool)
            hashes, where = hashes[fresh], where[fresh]
            if len(sent) > MEMO:
                sent.clear()
            sent.update(hashes.tolist())
            if len(every):
                owner = owners[i:j][row]
                yield pa.array(hashes.view(np.int64)), _gather(low, starts[where], ends[where]), pa.array(spots(owner[where], number[where])), (every.view(np.int64), number, owner)


def character_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of eight characters, with repeats."""
    if data.size and data.max() < 128:
        chars, at = data, offsets
    else:
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    wide = chars.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    wide ^= wide >> np.uint64(29)
    return K.shingles(wide, at, SHINGLE)


def character_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.distinct_in_rows(*character_shingles(data, offsets))


def _without(at: int, gone: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, kept = [], [], []
            for text, lines in zip(batch.column(at).to_pylist(), batch.column(gone).to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    n.append(0)
                    kept.append(0)
                    continue
                own = text.split("\n")
                out = set(lines or ())
                texts.append(text if not out else "\n".join(x for k, x in enumerate(own) if k not in out))
                n.append(len(own))
                kept.append(len(own) - len(out))
            rest = [(batch.column(c), batch.schema.names[c]) for c in range(batch.num_columns) if c != gone]
            rest[at - (gone < at)] = (pa.array(texts, pa.string()), rest[at - (gone < at)][1])
            yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], names=[*(x for _, x in rest), "n_lines", "n_kept"])

    return run


def _pruned(at: int, key: int, going, staying):
    """As `_without`, for rows whose lines that go are those in one filter and not in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(key)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            valid = batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            for i, j, data, offsets in K.pieces(batch.column(at)):
                starts, ends, row, number = lines_of(data, offsets)
                spot = spots(ids[i:j][row], number)
                hit = np.flatnonzero(sketches.might_hold(going.value, spot) & known[i:j][row])
                hit = hit[~sketches.might_hold(staying.value, spot[hit])]
                blank = (ends[hit] <= starts[hit]) | K.is_space(data[np.minimum(starts[hit], len(data) - 1)])
                blank[blank] = [K.is_space(data[starts[k] : ends[k]]).all() for k in hit[blank]]
                hit = hit[~blank]
                n = (np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets)) + 1) * valid[i:j]
                lost = np.bincount(row[hit], minlength=j - i)
                text = batch.column(at).slice(i, j - i)
                if len(hit):
                    stays = np.ones(len(data), bool)
                    # a line goes with the line feed after it, the last ones of a text with the one before them
                    for a, b in zip(starts[hit].tolist(), np.minimum(ends[hit] + 1, offsets[row[hit] + 1]).tolist(), strict=True):
                        stays[a:b] = False
                    live = np.arange(len(starts))
                    live[hit] = -1
                    before = np.maximum.accumulate(live)[hit]
                    last = (ends[hit] == offsets[row[hit] + 1]) & (before >= 0)
                    before = before[last][row[before[last]] == row[hit[last]]]
                    stays[ends[before]] = False
                    off = np.searchsorted(np.flatnonzero(~stays), offsets)
                    off = (offsets - off).astype(np.int32)
                    made = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(off), pa.py_buffer(data[stays])])
                    text = made if valid[i:j].all() else pc.if_else(pa.array(valid[i:j]), made, pa.scalar(None, pa.string()))
                rest = [batch.column(c).slice(i, j - i) if c != at else text.cast(pa.string()) for c in range(batch.num_columns) if c != key]
                names = [x for c, x in enumerate(batch.schema.names) if c != key]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n.astype(np.int64)), pa.array((n - lost).astype(np.int64))], names=[*names, "n_lines", "n_kept"])

    return run


def _in_filter(bloom, out: str):
    """(doc_id, line) -> spots of the lines, or ids of the documents, that a filter may hold; all without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = spots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            at = np.flatnonzero(sketches.might_hold(bloom.value, spot)) if bloom else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array((spot if out == "spot" else batch.column(0).to_numpy())[at])], names=[out])

    return run


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with only the lines that stay in its text, and n_lines, n_kept.

    Blank lines always stay.  A null text stays null, with no lines; an empty one has one
    blank line.  Documents whose id is null are passed through whole, and rows that repeat
    an id lose the lines that stand in the first place of none of them: a line repeated
    at one place of equal rows is one occurrence.  An empty table gives no rows.  Columns
    called n_lines or n_kept are replaced; all others pass through.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_kept")]
    key, out = fresh([*keep, "n_lines", "n_kept"], "id", "gone")
    text = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    links = linked(text, character_sets, LINK_NUM, LINK_DEN, N_PERM, BAND_ROWS, distinct_lines, character_shingles)
    scratch.drop(links.classes)
    others = scratch.keep(moved(links), "moved")
    # a line that stands in one place only and has no link stays: it takes no part in what follows
    several, parts = standing(links.places, others)
    others = others.withColumnRenamed("id", "h")
    lines = places_of(links.places, several, parts).select(F.col("id").alias("h"), F.col("place").alias("line"), F.col("owner").alias("doc_id"))
    lines = scratch.keep(lines.join(others, "h", "left").select("doc_id", "line", F.coalesce("component", "h").alias("g")), "lines")
    # rows of a group that has one place only need no second look; as a table, the places of a
    # group that stands in a third of all documents can be joined by several tasks
    first = lines.groupBy("g").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.keep(first.select("g", F.col("first.doc_id").alias("doc"), F.col("first.line").alias("at")), "first")
    goes = F.coalesce((F.col("doc_id") != F.col("doc")) | (F.col("line") != F.col("at")), F.lit(False))
    judged = scratch.keep(lines.join(first, "g", "left").select("doc_id", "line", goes.alias("goes")), "judged")
    scratch.drop(lines, first)

    # Texts are not shuffled: a line goes if it is in a filter of those that go and not in one of those
    # that stay but are in the first.  A document with a line that goes and is in both is joined.
    sc, gone, stay = docs.sparkSession.sparkContext, judged.filter("goes").select("doc_id", "line"), judged.filter("not goes").select("doc_id", "line")
    single = places_of(links.places, several, parts, within=False).select(F.col("owner").alias("doc_id"), F.col("place").alias("line"))
    going = sc.broadcast(sketches.bloom(gone.mapInArrow(K.trimming(_in_filter(None, "spot")), "spot long"), "spot", sketches.bits_for(MORE_BITS * gone.count())))
    false = scratch.keep(stay.unionByName(single).mapInArrow(K.trimming(_in_filter(going, "spot")), "spot long"), "false")
    staying = sc.broadcast(sketches.bloom(false, "spot", sketches.bits_for(MORE_BITS * false.count())))
    scratch.drop(links.places)
    open_ids = scratch.keep(gone.mapInArrow(K.trimming(_in_filter(staying, "doc_id")), "doc_id long"), "open").distinct()

    whole, id_long, at = docs.select(*[col(c) for c in keep]), col(id_col).cast("long"), keep.index(text_col)
    schema = schema_of(docs, keep, "n_lines long, n_kept long")
    if open_ids.isEmpty():
        return whole.withColumn(key, id_long).mapInArrow(_pruned(at, len(keep), going, staying), schema)
    some, rest = sketches.parted(whole, id_long, open_ids, "doc_id")
    lost = sketches.parted(gone, F.col("doc_id"), open_ids, "doc_id")[0]
    lost = scratch.keep(lost.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line").alias(out)), "gone")
    some = some.join(lost, id_long == col(key), "left").drop(key).mapInArrow(_without(at, len(keep)), schema)
    return some.unionByName(rest.withColumn(key, id_long).mapInArrow(_pruned(at, len(keep), going, staying), schema))
