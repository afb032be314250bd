"""Linking of similar sets by min-max hashing; the engine of document and line dedup.

An item is an integer id and a set of 64-bit shingle hashes.  Every permutation is
evaluated once a shingle and gives two signature values, the minimum and the maximum,
so 160 values cost 80 evaluations.  Bands of values retrieve candidates; a link counts
only after the full sets have been compared as integers
(`link_den * intersection >= link_num * union`).

Plan, in tables that are written and read again:

1. one pass over the text: set size, set fingerprint and band keys an item, packed as
   records, thousands a row; items with equal sets fold into the smallest id, within a task
   before the shuffle, so a group of copies of any size is one record from here on (equal
   sets have equal band keys);
2. band keys that several sets share, found by counting keys alone, by 32 bits within a
   part (a chance match only makes a bucket larger); the records are then read again
   behind a Bloom filter of those keys, with a table of the buckets' sizes, and their
   keys dealt packed.  In each bucket the member that collides most leads, and every other
   member is compared with its leader only (no pairs within a bucket are made); the rows
   of a bucket of very many sets are left to a join that can be split;
3. texts of the candidates, from a second pass behind a Bloom filter of the places where
   they were met, so that nothing else is hashed again; they travel in place of their sets, which are some
   times larger and are made anew where needed;
4. verified links -> distributed union-find;
5. buckets that still span several components: their members are compared across
   components by an exact prefix filter (rarest shingles first, with the bound that
   a shared shingle's place in either order sets), so no link is lost to the choice
   of leaders.  A shingle that only one set holds cannot link and costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitstrata.llm import kernels as K
from bitstrata.llm import scratch, sketches
from bitstrata.llm.components import components

SEED = 20250101
#: Bytes a kernel call works on here: its 64-bit intermediates then stay in a core's cache.
SLICE = 1 << 16
#: Band keys that a task counts at once, and that a part has on average.
KEYS_HELD, KEYS_A_PART = 1 << 20, 1 << 20
#: Records in a row of the signatures, that a task folds at once, and that a part has on average.
RECORDS, RECORDS_HELD, RECORDS_A_PART = 1 << 13, 1 << 16, 1 << 15
#: Prefix rows that a part has on average, pairs that a task makes at once, rows of a shingle over which it is left to a join.
PREFIXES_A_PART, PAIRS_HELD, HOT = 1 << 17, 1 << 20, 1 << 10
#: Binary logarithm of the members from which a bucket is large.
LARGE = 16
#: (bytes, offsets) of texts -> (set values laid end to end, bounds)
Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: integer spots -> which of them are asked for; None: all
Wanted = Callable[[np.ndarray], np.ndarray] | None
#: ids, places and owners of all occurrences of a source's items
Places = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (batches of the source, wanted) -> (ids, texts, spots, places or None); a spot is an integer that
#: stands for where an item was met, so that a second pass can tell without reading the item
Items = Callable[[Iterator[pa.RecordBatch], Wanted], Iterator[tuple[pa.Array, pa.Array, pa.Array, Places | None]]]
PREFIX = np.dtype([("token", np.uint64), ("pos", np.int64), ("node", np.int64), ("n", np.int64), ("component", np.int64)])
BUCKET = np.dtype([("band", np.int64), ("node", np.int64), ("rank", np.int64)])
PLACE = np.dtype([("id", np.int64), ("owner", np.int64), ("place", np.int64)])


class Linked(NamedTuple):
    """Tables of the items (id, n, fp_hi, fp_lo), packed records of the distinct sets, components (node,
    component) of the sets that have links, ids (id, rep) that fold into another id, packed places."""

    items: DataFrame | None
    classes: DataFrame
    found: DataFrame
    same: DataFrame | None
    places: DataFrame | None


def plain_items(batches: Iterator[pa.RecordBatch], wanted: Wanted = None) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, None]]:
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        if wanted is not None:
            at = pa.array(np.flatnonzero(wanted(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)))
            ids, text = ids.take(at), text.take(at)
        yield ids, text, ids, None


#: id and top: least and largest id of the set; n: its size, or -1 less that where the id is null.
HEAD = np.dtype([("hi", np.uint64), ("lo", np.uint64), ("n", np.int64), ("id", np.int64), ("top", np.int64), ("spot", np.int64)])


def _record(n_perm: int, rows: int) -> np.dtype:
    return np.dtype([*((c, HEAD[c]) for c in HEAD.names), ("bands", np.uint64, (2 * n_perm // rows,))])


def _unpacked(column: pa.Array, record: np.dtype) -> np.ndarray:
    """Records of all rows of a binary column."""
    blobs = [np.frombuffer(x.as_buffer(), record) for x in column if x.is_valid]
    return blobs[0] if len(blobs) == 1 else np.concatenate(blobs) if blobs else np.zeros(0, record)


def _signatures(items: Items, kernel: Kernel, n_perm: int, rows: int):
    record = _record(n_perm, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        stands: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            blobs = [pa.array([b"".join(x.tobytes() for x in part)], pa.binary()) for part in (held, stands)]
            n = pa.array([sum(map(len, held))])
            held.clear()
            stands.clear()
            return pa.RecordBatch.from_arrays([n, *blobs], names=["m", "items", "places"])

        for ids, text, spots, places in items(batches, None):
            if places is not None:
                stands.append(np.empty(len(places[0]), PLACE))
                stands[-1]["id"], stands[-1]["place"], stands[-1]["owner"] = places
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids, spots = (x.fill_null(0).to_numpy() for x in (ids, spots))
            for i, j, data, offsets in K.pieces(text, SLICE):
                sets, bounds = kernel(data, offsets)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                made = np.zeros(j - i, record)
                made["n"] = np.where(known[i:j], n, -1 - n)
                made["id"] = made["top"] = ids[i:j]
                made["spot"] = spots[i:j]
                if some.size:
                    tight = np.concatenate([bounds[some], bounds[-1:]])
                    made["hi"][some], made["lo"][some] = K.row_fingerprints(sets, tight)
                    made["bands"][some] = K.band_keys(K.minmax_signatures(sets, tight, n_perm, SEED), rows)
                held.append(made)
                if sum(map(len, held)) >= RECORDS:
                    yield out()
        if held or stands:
            yield out()

    return run


def _folded(records: np.ndarray) -> np.ndarray:
    """One record for each set, with the least id, its spot, and the largest id."""
    order = np.argsort(records["lo"])
    lo = records["lo"][order]
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = lo[1:] == lo[:-1]
    some = twice[1:] | twice[:-1]  # only equal ones need the other keys
    equal = records[order[some]]
    order[some] = order[some][np.lexsort((equal["id"], equal["n"], equal["hi"], equal["lo"]))]
    key = [records[c][order] for c in ("lo", "hi", "n")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    first = np.flatnonzero(fresh)
    out = records[order[first]]
    if len(first):
        out["top"] = np.maximum.reduceat(records["top"][order], first)
    return out


def _dealt(parts: int, record: np.dtype):
    """Records -> (part, items): dealt by fingerprint, folded for every RECORDS_HELD that a task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            records = _folded(np.concatenate(held))
            return pa.RecordBatch.from_arrays(_by_part(records, (records["lo"] % np.uint64(parts)).astype(np.int64), parts), names=["part", "items"])

        for batch in batches:
            for k in range(batch.num_rows):
                records = _unpacked(batch.column(0).slice(k, 1), record)
                held.append(records[records["n"] > 0])
                if sum(map(len, held)) >= RECORDS_HELD:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def _classes(sig: DataFrame, record: np.dtype) -> DataFrame:
    """(m, several, heads, bands) of the distinct sets: their number, how many have several ids, their records in two."""
    parts = max(16, -(-int(sig.agg(F.sum("m")).first()[0] or 0) // RECORDS_A_PART))

    def fold(key, table):
        records = _folded(_unpacked(table.column("items"), record))
        heads = np.empty(len(records), HEAD)
        for c in HEAD.names:
            heads[c] = records[c]
        blobs = {"heads": pa.array([heads.tobytes()], pa.binary()), "bands": pa.array([records["bands"].tobytes()], pa.binary())}
        return pa.table({"m": [len(records)], "several": [int(np.count_nonzero(heads["id"] != heads["top"]))], **blobs})

    return sig.select("items").mapInArrow(K.trimming(_dealt(parts, record)), "part long, items binary").groupBy("part").applyInArrow(fold, "m long, several long, heads binary, bands binary")


def _columns(packed: DataFrame, column: str, record: np.dtype) -> DataFrame:
    """(id, n, fp_hi, fp_lo, several) of the packed records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = _unpacked(batch.column(0).slice(k, 1), record)
                null = x["n"] < 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["id"], mask=null), pa.array(np.where(null, -1 - x["n"], x["n"])), *(pa.array(np.ascontiguousarray(x[c]).view(np.int64)) for c in ("hi", "lo")), pa.array(x["id"] != x["top"])],
                    names=["id", "n", "fp_hi", "fp_lo", "several"],
                )

    return packed.select(column).mapInArrow(K.trimming(run), "id long, n long, fp_hi long, fp_lo long, several boolean")


def places_of(packed: DataFrame, bloom, parts: int, within: bool = True) -> DataFrame:
    """(id, place, owner) of the packed places whose ids the filter of `standing` may hold, or of those that it doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column(0), PLACE)
            x = x[sketches.might_hold(bloom.value, _short(np.ascontiguousarray(x["id"]).view(np.uint64), parts).view(np.int64)) == within]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in ("id", "place", "owner")], names=["id", "place", "owner"])

    return packed.select("places").mapInArrow(K.trimming(run), "id long, place long, owner long")


def _short(keys: np.ndarray, parts: int) -> np.ndarray:
    """Keys by their part and 32 of their bits: all that a bucket is known by."""
    return keys % np.uint64(parts) << np.uint64(32) | keys >> np.uint64(32)


def _key_counts(parts: int, keys_of: Callable[[pa.Array], np.ndarray]):
    """Keys of the records -> (part, keys, counts): keys dealt by value, each once for every
    KEYS_HELD that a task has read, so that a key of very many sets is few entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)  # by part, then by value
            edge = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            some = np.flatnonzero(np.diff(edge))
            off = np.concatenate([edge[some], edge[-1:]]).astype(np.int32)
            blobs = [pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(off * np.int32(4)), pa.py_buffer(x.astype(np.uint32))]) for x in (keys & np.uint64(0xFFFFFFFF), n)]
            return pa.RecordBatch.from_arrays([pa.array(some), *blobs], names=["part", "keys", "counts"])

        for batch in batches:
            for k in range(batch.num_rows):
                held.append(_short(keys_of(batch.column(0).slice(k, 1)), parts))
                if sum(map(len, held)) >= KEYS_HELD:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def _shared_keys(key, table):
    """All that was dealt to a part -> (band, members) of the keys of several sets."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")])
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")]).astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(n, first)
    many = total > 1
    return pa.table({"band": keys[first[many]].astype(np.int64) | key[0].as_py() << 32, "members": total[many]})


def _shared(classes: DataFrame, parts: int) -> DataFrame:
    """(band, members) of the band keys that several sets have."""
    counted = _key_counts(parts, lambda column: _unpacked(column, np.dtype(np.uint64)))
    dealt = classes.select("bands").mapInArrow(K.trimming(counted), "part long, keys binary, counts binary")
    return dealt.groupBy("part").applyInArrow(_shared_keys, "band long, members long")


def standing(packed: DataFrame, others: DataFrame):
    """(broadcast filter, parts) of the ids of packed places that stand in several or are among `others`'
    (id, component); `_short` of an id is what the filter holds, so that a few more may pass."""
    n = int(packed.agg(F.sum(F.octet_length("places"))).first()[0] or 0) // PLACE.itemsize
    parts = max(16, min(1 << 20, -(-n // KEYS_A_PART)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(_short(batch.column(c).to_numpy().view(np.uint64), parts).view(np.int64))], names=["band"])

    counted = _key_counts(parts, lambda column: np.ascontiguousarray(_unpacked(column, PLACE)["id"]).view(np.uint64))
    several = packed.select("places").mapInArrow(K.trimming(counted), "part long, keys binary, counts binary").groupBy("part").applyInArrow(_shared_keys, "band long, members long")
    keys = scratch.keep(several.select("band").unionByName(others.mapInArrow(K.trimming(named), "band long")), "standing")
    bloom = sketches.bloom(keys, "band", sketches.bits_for(2 * keys.count()))
    scratch.drop(keys)
    return packed.sparkSession.sparkContext.broadcast(bloom), parts


def _shared_bands(bloom, sizes, parts: int, least: int, large: bool):
    """(heads, bands) -> (part, rows): packed rows of the keys that may be shared, dealt by key; where `large`
    (band, node, rank), for the buckets that may be larger than a part should be, which are else left out.
    A node's rank is one integer: the sizes of its buckets, then a hash; of equal sizes any may lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = _unpacked(batch.column(0).slice(k, 1), HEAD)["id"]
                keys = _short(_unpacked(batch.column(1).slice(k, 1), np.dtype(np.uint64)), parts).view(np.int64)
                width = max(1, len(keys) // max(1, len(ids)))
                at = np.concatenate([i + np.flatnonzero(sketches.might_hold(bloom.value, keys[i : i + SLICE])) for i in range(0, len(keys), SLICE)] or [np.zeros(0, np.int64)])
                own, power = at // width, sketches.level(sizes.value, keys[at])
                weight = np.minimum(np.bincount(own, np.exp2(power), len(ids)), 1 << 20).astype(np.int64)
                rank = weight << 42 | (K.mix64(ids.view(np.uint64)) >> np.uint64(22)).view(np.int64)
                some = np.flatnonzero((power >= least) == large)
                rows = np.empty(len(some), BUCKET)
                rows["band"], rows["node"], rows["rank"] = keys[at[some]], ids[own[some]], rank[own[some]]
                if large:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in BUCKET.names], names=list(BUCKET.names))
                else:
                    yield pa.RecordBatch.from_arrays(_by_part(rows, rows["band"] >> 32, parts), names=["part", "rows"])

    return run


def _by_part(rows: np.ndarray, part: np.ndarray, parts: int) -> list[pa.Array]:
    """(part, packed rows) of the parts that have rows."""
    order = np.argsort(part, kind="stable")
    rows, edge = rows[order], np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(edge))
    return [pa.array(some), pa.array([rows[edge[k] : edge[k + 1]].tobytes() for k in some], pa.binary())]


def _led(key, table):
    """All packed rows of a part -> (band, node, a, members) of the buckets of several members, but for their leaders a."""
    x = _unpacked(table.column("rows"), BUCKET)
    x = x[np.lexsort((x["rank"], x["band"]))]
    first = np.flatnonzero(np.concatenate([[True], x["band"][1:] != x["band"][:-1]]))
    size = np.diff(np.concatenate([first, [len(x)]]))
    leader = np.repeat(x["node"][first + size - 1], size)
    at = np.flatnonzero(x["node"] != leader)
    return pa.table({"band": x["band"][at], "node": x["node"][at], "a": leader[at], "members": np.repeat(size, size)[at]})


def _buckets(classes: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    """(band, node, a, members): each bucket's members with its leader, the member that collides most; without the leader."""
    spark, n = classes.sparkSession, shared.count()
    bloom = spark.sparkContext.broadcast(sketches.bloom(shared, "band", sketches.bits_for(n)))
    sizes = spark.sparkContext.broadcast(sketches.levels(shared, "band", "members", sketches.cells_for(n)))
    packed = classes.select("heads", "bands").mapInArrow(K.trimming(_shared_bands(bloom, sizes, parts, LARGE, False)), "part long, rows binary")
    out = packed.groupBy("part").applyInArrow(_led, "band long, node long, a long, members long")
    if not shared.filter(F.col("members") >= 1 << LARGE).isEmpty():  # by a join that can be split
        rows = scratch.keep(classes.select("heads", "bands").mapInArrow(K.trimming(_shared_bands(bloom, sizes, parts, LARGE, True)), "band long, node long, rank long"), "large")
        leaders = rows.groupBy("band").agg(F.max_by("node", "rank").alias("a"), F.count("*").alias("members"))
        out = out.unionByName(rows.join(leaders, "band").filter("node <> a").select("band", "node", "a", "members"))
    return scratch.keep(out, "buckets")


def _spots(bloom):
    """Heads -> spots of those whose id may be held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = _unpacked(batch.column(0).slice(k, 1), HEAD)
                yield pa.RecordBatch.from_arrays([pa.array(x["spot"][sketches.might_hold(bloom.value, np.ascontiguousarray(x["id"]))])], names=["spot"])

    return run


def _candidates(items: Items, kernel: Kernel, bloom):
    """(node, set size, text) of the items that may be candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text, _, _ in items(batches, lambda found: sketches.might_hold(bloom.value, found)):
            if len(ids):
                n = [np.diff(kernel(data, offsets)[1]) for _, _, data, offsets in K.pieces(text, SLICE)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(n)), text.cast(pa.string())], names=["node", "n", "text"])

    return run


def _rows(kernel: Kernel, text: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text in turn."""
    for i, j, data, offsets in K.pieces(text, SLICE):
        sets, bounds = kernel(data, offsets)
        for k in range(j - i):
            yield sets[bounds[k] : bounds[k + 1]]


def _confirm(kernel: Kernel, num: int, den: int):
    """(a, b, text of a, text of b) -> (a, b) where the full sets are similar enough.
    A text that stands in many pairs of a batch, as a leader's does, is cut into shingles once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            one, two = (pc.dictionary_encode(batch.column(c)) for c in (2, 3))
            left, right = (list(_rows(kernel, x.dictionary)) for x in (one, two))
            for k, (i, j) in enumerate(zip(one.indices.to_pylist(), two.indices.to_pylist(), strict=True)):
                x, y = left[i], right[j]
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[k] = den * common >= num * (len(x) + len(y) - common)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _rare_prefixes(kernel: Kernel, num: int, den: int, counts, parts: int):
    """A similar pair shares one of each side's n - ceil(t * n) + 1 rarest shingles, in any
    order that is the same for all sets.  At the first shingle they share, `pos` shingles
    of a side lie before it and can't be in common.  Shingles counted once are left out.
    (part, rows): packed, dealt by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, nodes, components = [], batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for k, x in enumerate(_rows(kernel, batch.column(3))):
                n = len(x)
                seen = sketches.estimate(counts.value, x)
                first = np.lexsort((x, seen))[: n - -(-num * n // den) + 1]
                place = np.flatnonzero(seen[first] > 1)
                made = np.empty(len(place), PREFIX)
                made["token"], made["pos"], made["n"], made["node"], made["component"] = x[first[place]], place, n, nodes[k], components[k]
                held.append(made)
            if held:
                rows = np.concatenate(held)
                yield pa.RecordBatch.from_arrays(_by_part(rows, (rows["token"] % np.uint64(parts)).astype(np.int64), parts), names=["part", "rows"])

    return run


def _across(num: int, den: int, hot: int):
    """All prefix rows of a part -> (token, pos, node, n, component, b): pairs node < b across components that
    share a shingle early enough; for shingles of more than `hot` rows the rows, b null."""

    def run(key, table):
        x = _unpacked(table.column("rows"), PREFIX)
        x = x[np.argsort(x["token"], kind="stable")]
        token, pos, node, n, component = (np.ascontiguousarray(x[c]) for c in PREFIX.names)
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.concatenate([start, [len(x)]]))
        mixed = np.minimum.reduceat(component, start) != np.maximum.reduceat(component, start)
        end = np.repeat(start + size, size)
        plenty = np.flatnonzero(np.repeat(mixed & (size > hot), size))
        one = np.flatnonzero(np.repeat(mixed & (size <= hot), size))
        n_more = end[one] - one - 1
        reach, found, k = np.cumsum(n_more), [np.zeros((0, 2), np.int64)], 0
        while k < len(one):
            to = max(k + 1, int(np.searchsorted(reach, reach[k] - n_more[k] + PAIRS_HELD, "right")))
            many = n_more[k:to]
            a = np.repeat(one[k:to], many)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            need = (n[a] + n[b]) * num  # least overlap times (num + den)
            ok = (component[a] != component[b]) & ((n[a] - pos[a]) * (num + den) >= need) & ((n[b] - pos[b]) * (num + den) >= need)
            a, b = node[a[ok]], node[b[ok]]
            pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            found.append(pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])[: len(pairs)]])
            k = to
        pairs = np.concatenate(found)
        rest = pa.table({"token": token[plenty].view(np.int64), "pos": pos[plenty], "node": node[plenty], "n": n[plenty], "component": component[plenty], "b": pa.nulls(len(plenty), pa.int64())})
        none = pa.nulls(len(pairs), pa.int64())
        return pa.concat_tables([rest, pa.table({"token": none, "pos": none, "node": pairs[:, 0].copy(), "n": none, "component": none, "b": pairs[:, 1].copy()})])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, kernel: Kernel, num: int, den: int) -> DataFrame:
    """pairs (a, b), each once, with a's and b's texts at hand: they are smaller than their sets."""
    one = texts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("text").alias("tb"))
    near = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    return pairs.join(two, "b").join(one, "a").filter(near).select("a", "b", "ta", "tb").mapInArrow(K.trimming(_confirm(kernel, num, den)), "a long, b long")


def linked(source: DataFrame, kernel: Kernel, link_num: int, link_den: int, n_perm: int, band_rows: int, items: Items = plain_items, loose: Kernel | None = None) -> Linked:
    """Links all sets of the source.  Its items are given where they are plain ones, ids that fold into
    another id and places where they aren't.  Empty sets and null ids have no class.  Plain rows that
    repeat an id are one item, linked by any of its sets; ids of other items stand for their sets.
    """
    spark, plain = source.sparkSession, items is plain_items
    record = _record(n_perm, band_rows)
    sig = scratch.keep(source.mapInArrow(K.trimming(_signatures(items, loose or kernel, n_perm, band_rows)), "m long, items binary, places binary"), "signatures", compression="none")
    classes = scratch.keep(_classes(sig, record), "classes", compression="none")
    n, several = (int(x or 0) for x in classes.agg(F.sum("m"), F.sum("several")).first())
    own = scratch.keep(_columns(sig, "items", record).drop("several"), "items") if plain else None
    same = None
    if several and not plain:
        reps = _columns(classes, "heads", HEAD).filter("several").select("fp_hi", "fp_lo", "n", F.col("id").alias("rep"))
        same = scratch.keep(_columns(sig, "items", record).join(reps, ["fp_hi", "fp_lo", "n"]).filter("id <> rep").select("id", "rep").distinct(), "same")
    places = None if plain else scratch.keep(sig.select("places"), "places")
    scratch.drop(sig)

    parts = max(16, min(1 << 20, -(-n * len(np.zeros(1, record)["bands"][0]) // KEYS_A_PART)))
    shared = scratch.keep(_shared(classes, parts), "shared")
    buckets = _buckets(classes, shared, parts)
    scratch.drop(shared)
    star = scratch.keep(buckets.select("a", F.col("node").alias("b")).distinct(), "star")

    bits = sketches.bits_for(4 * star.count())  # a false hit is a text to shuffle
    bloom = sketches.bloom(star.select(F.explode(F.array("a", "b")).alias("node")), "node", bits)
    if not plain:
        bloom = sketches.bloom(classes.select("heads").mapInArrow(K.trimming(_spots(spark.sparkContext.broadcast(bloom))), "spot long"), "spot", bits)
    met = source.mapInArrow(K.trimming(_candidates(items, kernel, spark.sparkContext.broadcast(bloom))), "node long, n long, text string")
    texts = scratch.keep(met.repartition("node").dropDuplicates(["node", "text"]), "candidates")

    links = scratch.keep(_verified(star, texts, kernel, link_num, link_den), "links")
    found = components(links)

    # a leader has met all of its bucket: what is open lies between the others
    at = buckets.filter("members > 2").select("band", "node").join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    open_bands = at.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band")
    rest = scratch.keep(at.join(open_bands, "band", "left_semi").select("node", "component").distinct(), "rest")
    if not rest.isEmpty():
        members = scratch.keep(rest.join(texts, "node").select("node", "n", "component", "text"), "members")  # read three times
        held = int(members.agg(F.sum("n")).first()[0] or 0)
        counts = spark.sparkContext.broadcast(sketches.counts(members, "text", lambda column: _rows(kernel, column), sketches.cells_for(held)))
        parts = max(16, held * (link_den - link_num) // link_den // PREFIXES_A_PART)
        prefix = members.mapInArrow(K.trimming(_rare_prefixes(kernel, link_num, link_den, counts, parts)), "part long, rows binary")
        met = prefix.groupBy("part").applyInArrow(_across(link_num, link_den, HOT), "token long, pos long, node long, n long, component long, b long")
        met = scratch.keep(met, "prefixes")
        scratch.drop(members)
        across, prefix = met.filter("b is not null").select(F.col("node").alias("a"), "b"), met.filter("b is null")
        if not prefix.isEmpty():  # shingles of very many sets: by a join that can be split
            other = prefix.select("token", F.col("pos").alias("pb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
            need = (F.col("n") + F.col("nb")) * link_num
            reach = ((F.col("n") - F.col("pos")) * (link_num + link_den) >= need) & ((F.col("nb") - F.col("pb")) * (link_num + link_den) >= need)
            joined = prefix.drop("b").join(other, "token").filter((F.col("node") < F.col("b")) & (F.col("component") != F.col("cb")) & reach)
            across = across.unionByName(joined.select(F.col("node").alias("a"), "b"))
        done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("done"))
        across = across.withColumn("done", F.lit(0)).unionByName(done).groupBy("a", "b").agg(F.max("done").alias("done")).filter("done = 0")
        more = scratch.keep(_verified(across.select("a", "b"), texts, kernel, link_num, link_den), "links")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    scratch.drop(buckets, star, texts, links, rest)
    return Linked(own, classes, found, same, places)


def homes(links: Linked) -> DataFrame:
    """(fp_hi, fp_lo, n, component) of every distinct set, where component is the smallest id reachable."""
    reps = _columns(links.classes, "heads", HEAD).select("fp_hi", "fp_lo", "n", F.col("id").alias("rep"))
    out = reps.join(links.found.withColumnRenamed("node", "rep"), "rep", "left").select("fp_hi", "fp_lo", "n", F.coalesce("component", "rep").alias("component"))
    out = scratch.keep(out, "homes")
    scratch.drop(links.classes)
    return out


def moved(links: Linked) -> DataFrame:
    """(id, component) of the ids whose component is another id."""
    out = links.found.select(F.col("node").alias("id"), "component")
    if links.same is not None:
        out = out.unionByName(links.same.join(links.found.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component")))
    return out.filter("id <> component").distinct()
