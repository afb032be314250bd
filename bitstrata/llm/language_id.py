"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (two and three bytes of the
lower-cased text, all ASCII bytes that are not letters read as one blank),
weighted by sub-linear term frequency times inverse document frequency and
scaled to length one.  Each language has several centroids, found by spherical
k-means, and a text takes the language of the centroid with the largest cosine.
It is rejected if that cosine is far below what training texts of its length
reach.

Document frequencies, centroids and limits cover every training row: k-means only
starts from a bounded sample (`MAX_FIT_ROWS` rows in all, chosen by a hash of the id),
which is what reaches the driver; each of `ROUNDS` passes over all training rows then
makes every centroid the mean of the rows nearest to it, and one more pass counts the
cosines that the limits come from.  Prediction is one pass over the text without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitstrata.llm import kernels as K
from bitstrata.llm.names import col, fresh, quoted, schema_of

DIM = 2048
MAX_FIT_ROWS = 3000
CENTROIDS = 4
#: Texts whose counts (16 kB each) are held at once.
PIECE_ROWS = 512
#: Passes of k-means over all training rows.
ROUNDS = 3
#: A text is rejected below this part of the cosine that all but this share of its length class's
#: training rows reach; cosines are counted in so many bins.
REJECT_PART, REJECT_SHARE, BINS = 0.5, 1e-3, 4096
#: Sums of vectors are whole numbers of this part of one, so they don't depend on their order.
UNIT = 1 << 24
_SHIFT = np.uint32(32 - 11)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (rows, DIM)
    lang_of: np.ndarray
    floor: np.ndarray  # by length class


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, (rows, DIM) counts, n-grams a row), of `PIECE_ROWS` rows at most."""
    for lo in range(0, len(column), PIECE_ROWS):
        for i, j, counts, total in _term_counts(column.slice(lo, PIECE_ROWS)):
            yield lo + i, lo + j, counts, total


def _term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in K.pieces(pc.utf8_lower(column.fill_null("")), 1 << 19):
        rows = j - i
        folded = _FOLD[data]
        row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
        blank = folded == 32
        out = np.zeros(rows * DIM, np.int64)
        for n in (2, 3):
            if len(folded) < n:
                continue
            m = len(folded) - n + 1
            code = np.full(m, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(257) + folded[k : k + m]
            ok = (row[:m] == row[n - 1 :]) & ~(blank[:m] & blank[1 : m + 1])
            if n == 3:
                ok &= ~(blank[1 : m + 1] & blank[2 : m + 2])
            slot = ((code * np.uint32(0x9E3779B1)) >> _SHIFT)[ok].astype(np.int64)
            out += np.bincount(row[:m][ok].astype(np.int64) * DIM + slot, minlength=rows * DIM)
        counts = out.reshape(rows, DIM)
        yield i, j, counts, counts.sum(1)


def _length_class(n_grams: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_grams, 1)).astype(np.int64), 23)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for _, _, counts, total in term_counts(batch.column(0)):
            df += (counts > 0).sum(0)
            n += int((total > 0).sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], df]))], names=["slot", "n"])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, counts, _ in term_counts(batch.column(1)):
            raw = np.minimum(counts, 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in raw], pa.binary())], names=["lang", "counts"])


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; centroids that lose their rows are left out."""
    at = [int(rng.integers(len(x)))]
    near = x @ x[at[0]]
    while len(at) < min(k, len(x)):  # farthest first
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == g].sum(0) for g in range(len(c)) if (own == g).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _slots(values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(values[at])], names=["slot", "n"])


def _nearest(shared, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, length classes, nearest centroid of the row's own language, its cosine) of (lang, text) rows."""
    langs, idf, centroids, lang_of = shared.value
    own = np.array([langs[x] for x in batch.column(0).to_pylist()], np.int64)
    for i, j, counts, total in term_counts(batch.column(1)):
        x = _vectors(counts, idf)
        cos = np.where(lang_of == own[i:j, None], x @ centroids.T, -1.0)
        best = cos.argmax(1)
        yield x, _length_class(total), best, cos[np.arange(j - i), best]


def _centroid_sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shared.value[2].shape, np.int64)
        for batch in batches:
            for x, _, best, _ in _nearest(shared, batch):
                whole = np.rint(x * np.float32(UNIT)).astype(np.int64)
                for g in np.unique(best):
                    sums[g] += whole[best == g].sum(0)
        yield _slots(sums.ravel())

    return run


def _cosine_counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(24 * BINS, np.int64)
        for batch in batches:
            for _, size, _, cos in _nearest(shared, batch):
                n += np.bincount(size * BINS + np.clip(cos * BINS, 0, BINS - 1).astype(np.int64), minlength=len(n))
        yield _slots(n)

    return run


def _over_all(train: DataFrame, run, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in train.select("lang", "text").mapInArrow(K.trimming(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r.slot] = r.n
    return out


def fit(train: DataFrame, max_rows: int = MAX_FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """train: (id long, text string, lang string), nothing null."""
    spark = train.sparkSession
    stats = train.select("text").mapInArrow(K.trimming(_document_frequencies), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1, np.int64)
    for r in stats:
        df[r.slot + 1] = r.n
    idf = (np.log((1.0 + df[0]) / (1.0 + df[1:])) + 1.0).astype(np.float32)
    per = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # of each language the rows with the least hashes, as many as its share: first those below a
    # limit that about twice as many pass, then, of a language that has too few there, of all its rows
    most = max(1, -(-max_rows // max(1, len(per))))
    hashed = F.xxhash64(F.lit(17), "id", "text")
    shares = spark.createDataFrame([(lang, min(1.0, 2.0 * most / n)) for lang, n in per.items()], "label string, share double")
    low = F.pmod(hashed, F.lit(1 << 30)) < F.col("share") * (1 << 30)
    order = Window.partitionBy("lang").orderBy(F.pmod(hashed, F.lit(1 << 30)), "id", "text")
    x, y = [], []

    def take(rows: DataFrame) -> None:
        best = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
        for r in best.select("lang", "text").mapInArrow(_sample_counts, "lang string, counts binary").collect():
            x.append(np.frombuffer(bytes(r.counts), np.uint16))
            y.append(r.lang)

    take(train.join(F.broadcast(shares), F.col("lang") == F.col("label")).filter(low).select("id", "text", "lang"))
    short = [(g,) for g, n in per.items() if y.count(g) < min(most, n)]
    if short:
        for g in [g for (g,) in short]:
            keep = [k for k, lang in enumerate(y) if lang != g]
            x, y = [x[k] for k in keep], [y[k] for k in keep]
        rest = train.join(F.broadcast(spark.createDataFrame(short, "label string")), F.col("lang") == F.col("label"))
        take(rest.select("id", "text", "lang"))
    langs = sorted(per)
    if not x:
        return Model([], idf, np.zeros((0, DIM), np.float32), np.zeros(0, np.int64), np.zeros(24, np.float32))
    counts, labels = np.stack(x), np.array(y)
    order = np.lexsort((*counts[:, :3].T, counts.astype(np.int64).sum(1), labels))
    counts, labels = counts[order], labels[order]
    v, rng, parts, lang_of = _vectors(counts, idf), np.random.default_rng(5), [], []
    langs = [g for g in langs if (labels == g).any()]
    for g, lang in enumerate(langs):
        c = _cluster(v[labels == lang], centroids, rng)
        parts.append(c)
        lang_of += [g] * len(c)
    c, lang_of = np.concatenate(parts).astype(np.float32), np.array(lang_of)
    where = {lang: g for g, lang in enumerate(langs)}
    share = lambda: spark.sparkContext.broadcast((where, idf, c, lang_of))
    for _ in range(ROUNDS):
        sums = _over_all(train, _centroid_sums(share()), c.size).reshape(c.shape) / UNIT
        some = sums.any(1)  # one that no row is nearest to stays where it is
        c[some] = sums[some] / np.maximum(np.linalg.norm(sums[some], axis=1, keepdims=True), 1e-12)
    seen = _over_all(train, _cosine_counts(share()), 24 * BINS).reshape(24, BINS)
    floor = np.zeros(24, np.float32)
    least = 1.0
    for k in range(23, -1, -1):  # a shorter text never has to be nearer than a longer one
        if seen[k].any():
            least = min(least, float(np.searchsorted(np.cumsum(seen[k]), REJECT_SHARE * seen[k].sum(), "right")) / BINS)
        floor[k] = REJECT_PART * least
    floor[: int(np.flatnonzero(seen.any(1))[0])] = 0.0  # no evidence on texts as short as these
    return Model(langs, idf, c, lang_of, floor)


def _predict(shared, at: int, drop: bool, out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            text = batch.column(at)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, score, low = np.full(len(text), len(m.langs)), np.zeros(len(text)), np.ones(len(text), bool)
            if m.langs:
                for i, j, counts, total in term_counts(text):
                    cos = _vectors(counts, m.idf) @ m.centroids.T
                    best = cos.argmax(1)
                    lang[i:j] = m.lang_of[best]
                    score[i:j] = np.clip(cos[np.arange(j - i), best], 0.0, 1.0)
                    low[i:j] = score[i:j] < m.floor[_length_class(total)]
            lang[~letters] = len(m.langs)
            score[~letters] = 0.0
            kept = batch.num_columns - drop
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(names[lang], pa.string()), pa.array(score, pa.float64()), pa.array(low | ~letters)], names=[*batch.schema.names[:kept], *out]
            )

    return run


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == rest, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None, carry: tuple[str, ...] = (), names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """(id, carried columns, lang_pred, score, rejected) for every row.

    `train` marks the rows to learn from; those with a null id, text or label, or
    without a letter, never are.  Of each language at most its equal part of
    `MAX_FIT_ROWS` rows (one at least), those with the least hash of id and text, are
    what the centroids start from; all training rows then move them and set the limits.  A text that is null, empty or has no letter is
    `und`, score 0, rejected.  Without training rows every text is.  Repeated ids
    and texts are separate rows.  An empty table gives no rows.  `names` are those of the
    three new columns; a carried column of such a name is replaced, so a caller that
    carries columns of any name gives names that none of them has.
    """
    mark = F.lit(True) if train is None else train
    rows = docs.filter(mark).select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang")).dropna()
    model = fit(rows.filter(F.col("text").rlike(r"\p{L}")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = {n.lower() for n in names}
    own = [c for c in docs.columns if (c == id_col or c in carry) and c.lower() not in taken]
    apart = [] if text_col in own else [col(text_col).cast("string").alias(fresh(own, "text")[0])]
    at = own.index(text_col) if text_col in own else len(own)
    schema = schema_of(docs, own, f"{quoted(names[0])} string, {quoted(names[1])} double, {quoted(names[2])} boolean")
    return docs.select(*[col(c) for c in own], *apart).mapInArrow(K.trimming(_predict(shared, at, bool(apart), list(names))), schema)
