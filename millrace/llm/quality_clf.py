"""Quality scores from compression under dictionaries of good and of bad text."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_batches, written

#: Labelled texts of either label that are fitted, in expectation.
SAMPLE = 1500
#: Pieces (of PART characters, over the full length of those texts) of either label that train a dictionary, in expectation at most.
PIECES = 6000
DICTIONARY = 112_640
LEVEL = 3
SCALE = 10.0  # of size differences in the logistic calibration, so that its ridge is small beside them
PART = 4096  # bytes compressed (characters trained on) at once, so that a text's end counts as its beginning does


def _compressors(good: bytes, bad: bytes):
    import zstandard as zs

    def of(d):
        return zs.ZstdCompressor(level=LEVEL, dict_data=zs.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) if d else zs.ZstdCompressor(level=LEVEL, write_content_size=False)

    return of(good), of(bad)


def difference(text: str | None, pair) -> float:
    """The normalised compressed-size difference (bad - good) / (bad + good) of a whole text, which is compressed in parts."""
    b = (text or "").encode("utf-8", "surrogatepass")
    good, bad = pair
    gs = bs = 0
    for a in range(0, max(len(b), 1), PART):
        part = b[a : a + PART]
        gs, bs = gs + len(good.compress(part)), bs + len(bad.compress(part))
    return (bs - gs) / (bs + gs)


def _spread(parts: list[bytes], most: int) -> bytes:
    """Whole pieces from all over the list, evenly spaced, of so many bytes at most; the first alone may be cut."""
    n = sum(map(len, parts))
    step = max(1, -(-n // most))
    out, size = [], 0
    for p in [q for k in range(step) for q in parts[k::step]]:
        if size + len(p) <= most:
            out.append(p)
            size += len(p)
    return b"".join(out) if out or not parts else parts[0][:most]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[bytes, bytes, list[float]]:
    """(good dictionary, bad dictionary, calibration) from a bounded sample of labelled rows.

    Of each label those ids whose md5 is under sample / rows of the label are taken from labels; this list, bounded by sample, meets docs in a
    broadcast join. Whole texts of two thirds of it, in pieces, train the dictionaries on the driver; where a label has more than PIECES,
    the md5 of id and place chooses among them over the full length. The rest calibrates (whole texts) by ridge-penalised logistic regression. Rows that lack a label or an id count for nothing. A label without rows leaves an
    empty dictionary; without any rows every score is 0.5.
    """
    import zstandard as zs

    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y in (0, 1) and id is not null")
    n = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return b"", b"", []
    h = F.md5(F.col("id").cast("string").cast("binary"))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)
    share = F.create_map(*[F.lit(x) for y in n for x in (y, min(1.0, sample / n[y]))])[F.col("y")]
    taken = own.where(u < share).distinct().withColumn("fit", F.pmod(F.conv(F.substring(h, 9, 8), 16, 10).cast("long"), F.lit(3)) < 2)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = written(texts.join(F.broadcast(taken), "id").select("id", "y", "fit", "text"), "labelled")
    cut = F.expr(f"transform(sequence(0, CAST(greatest(0, ceil(length(text) / {PART}) - 1) AS INT)), i -> substring(text, i * {PART} + 1, {PART}))")
    pieces = rows.where("fit").select("id", "y", F.posexplode(cut).alias("at", "piece")).where("piece != ''")
    many = {r.y: r.n for r in pieces.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    dicts = []
    if many:
        v = F.conv(F.substring(F.md5(F.concat_ws(" ", "id", "at").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        share = F.create_map(*[F.lit(x) for y in many for x in (y, min(1.0, PIECES / many[y]))])[F.col("y")]
        to_fit = pieces.where(v < share).select("id", "y", "at", F.encode("piece", "utf-8").alias("b")).orderBy("id", "y", "at", "b").collect()
    else:
        to_fit = []
    for y in (1, 0):
        parts = [bytes(r.b) for r in to_fit if r.y == y]
        size = min(DICTIONARY, max(1024, sum(map(len, parts)) // 8))
        try:
            dicts.append(zs.train_dictionary(size, parts, level=LEVEL).as_bytes())
        except zs.ZstdError:  # too few or too uniform texts to train on: their bytes are the dictionary
            dicts.append(_spread(parts, DICTIONARY))
    good, bad = dicts
    held = _scored(rows.where("not fit"), good, bad, "text", ["id", "y"], None).select("id", "y", "score").orderBy("id", "y", "score").collect()
    held = held or _scored(rows, good, bad, "text", ["id", "y"], None).select("id", "y", "score").orderBy("id", "y", "score").collect()
    if not held:
        return good, bad, []
    x, y = np.array([[1.0, SCALE * r.score] for r in held]), np.array([r.y for r in held], float)
    # weights bring the sample back to the labels' true shares
    seen = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([n.get(int(k), 0) / seen[int(k)] for k in y])
    weight *= len(y) / weight.sum()
    c = np.zeros(2)
    ridge = np.diag([1e-3, 0.05])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge @ c)
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return good, bad, c.tolist()


def _scored(docs: DataFrame, good: bytes, bad: bytes, text_col: str, names: list[str], calibration: list[float] | None) -> DataFrame:
    """The score of each text, or without a calibration its size difference."""
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def make():
        pair = _compressors(*shared.value)

        def run(texts):
            if calibration is None:
                return [[difference(t, pair) for t in texts]]
            if not calibration:
                return [[0.5] * len(texts)]
            bias, slope = calibration
            return [[1 / (1 + math.exp(-max(-30.0, min(30.0, bias + slope * SCALE * difference(t, pair))))) for t in texts]]

        return run

    return map_batches(docs, make, [T.StructField("score", T.DoubleType())], [text_col], names)


def score_quality(docs: DataFrame, model: tuple[bytes, bytes, list[float]], *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all, if None) with score: how likely each whole text is good.

    A null text scores as an empty one. Repeated rows stay; an empty table gives no rows; a column named score is replaced. The two
    dictionaries have a fixed size and go to the workers; no shuffle.
    """
    return _scored(docs, model[0], model[1], text_col, [c for c in (docs.columns if keep is None else keep) if c != "score"], model[2])
