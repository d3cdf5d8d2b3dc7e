"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

Method. A text's UTF-8 bytes become learned vectors; learned filters look at 8-byte chunks that start
every 4 bytes, so that chunks overlap and cover the whole text; the filters' answers are max-pooled
over spans of 64 chunks; the mean and the maximum of the spans' pools go through one hidden layer into
one probability. Very long texts are read in blocks, so memory does not grow with them.

Defined cases. A null or empty text is scored as two groups of padding. Null ids, languages and
sources change nothing: only the text is read. Repeated rows get equal scores. Without any labelled
row each score is 0.5. Columns besides doc_id and text are ignored, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import sample_key

DIM, FILTERS, HIDDEN = 6, 32, 16
GROUP, SPAN, BLOCK = 4, 64, 1 << 16
#: The fit reads at most this many labelled rows, whole. It takes at most PIECE spans at a time.
TRAIN_ROWS, PIECE = 3000, 2048
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 11


def pool(model: dict, data: bytes) -> np.ndarray:
    """Mean and maximum over spans of the filters' maxima, over all bytes of data."""
    groups = max(2, -(-len(data) // GROUP))
    total, top, spans = np.zeros(FILTERS, np.float32), np.full(FILTERS, -np.inf, np.float32), 0
    for start in range(0, groups - 1, BLOCK // GROUP):
        stop = min(groups, start + BLOCK // GROUP + 1)
        piece = np.full((stop - start) * GROUP, 256, np.int16)
        raw = np.frombuffer(data, np.uint8, count=max(0, min(len(data), stop * GROUP) - start * GROUP), offset=min(len(data), start * GROUP))
        piece[: len(raw)] = raw
        x = model["emb"][piece].reshape(stop - start, GROUP * DIM)
        z = x[:-1] @ model["w0"]
        z += x[1:] @ model["w1"]
        best = np.maximum.reduceat(z, np.arange(0, len(z), SPAN))
        np.maximum(best + model["b"], 0, out=best)
        total += best.sum(0)
        np.maximum(top, best.max(0), out=top)
        spans += len(best)
    return np.concatenate([total / spans, top])


def head(model: dict, features: np.ndarray) -> np.ndarray:
    hidden = np.maximum(features @ model["h"] + model["hb"], 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ model["o"] + model["ob"], -30, 30)))


def _cells(data: bytes) -> np.ndarray:
    """Groups of GROUP bytes, padded."""
    groups = max(2, -(-len(data) // GROUP))
    out = np.full(groups * GROUP, 256, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(groups, GROUP)


def _span_pieces(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many groups laid end to end: the first group of each span, its chunks, and its text."""
    chunks = groups - 1
    spans = -(-chunks // SPAN)
    text = np.repeat(np.arange(len(groups)), spans)
    inside = (np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN
    return np.repeat(np.cumsum(groups) - groups, spans) + inside, np.minimum(SPAN, chunks[text] - inside), text


def _best(model: dict, cells: np.ndarray, first: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filters' maxima in each span, without bias, and the chunks that give them."""
    best, where = np.empty((len(first), FILTERS), np.float32), np.empty((len(first), FILTERS), np.int64)
    for k in range(0, len(first), PIECE):
        s = slice(k, k + PIECE)
        at = first[s][:, None] + np.minimum(np.arange(SPAN + 1), live[s][:, None])
        e = model["emb"][cells[at]].reshape(*at.shape, GROUP * DIM)
        z = e[:, :-1] @ model["w0"]
        z += e[:, 1:] @ model["w1"]
        z[np.arange(SPAN)[None] >= live[s][:, None]] = -1e9
        top = z.argmax(1)
        best[s], where[s] = np.take_along_axis(z, top[:, None], 1)[:, 0], first[s][:, None] + top
    return best, where


def fit(samples: list[tuple[bytes, int]], seed: int = SEED) -> dict:
    """Adam on the log loss. samples: whole texts and labels. Gradients touch only the chunks that give a span's maxima."""
    rng = np.random.default_rng(seed)
    model = {
        "emb": rng.normal(0, 0.5, (257, DIM)), "w0": rng.normal(0, 0.2, (GROUP * DIM, FILTERS)), "w1": rng.normal(0, 0.2, (GROUP * DIM, FILTERS)), "b": np.zeros(FILTERS),
        "h": rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)), "hb": np.zeros(HIDDEN), "o": rng.normal(0, 0.2, HIDDEN), "ob": np.zeros(1),
    }
    model = {k: v.astype(np.float32) for k, v in model.items()}
    model["emb"][256] = 0
    if not samples:
        model["o"][:] = 0
        return model
    y = np.array([label for _, label in samples], np.float32)
    moved, squared, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            step += 1
            own = [_cells(samples[i][0]) for i in batch.tolist()]
            cells, n = np.concatenate(own), len(own)
            first, live, text = _span_pieces(np.array([len(x) for x in own]))
            best, where = _best(model, cells, first, live)
            best += model["b"]
            act = np.maximum(best, 0)
            starts = np.searchsorted(text, np.arange(n))
            count = np.bincount(text, minlength=n)[:, None]
            peaks = np.maximum.reduceat(act, starts)
            features = np.concatenate([np.add.reduceat(act, starts) / count, peaks], 1)
            pre = features @ model["h"] + model["hb"]
            hidden = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model["o"] + model["ob"], -30, 30)))
            d = (p - y[batch]) / n
            grad = {"o": hidden.T @ d, "ob": d.sum(keepdims=True)}
            dh = d[:, None] * model["o"] * (pre > 0)
            grad |= {"h": features.T @ dh, "hb": dh.sum(0)}
            df = dh @ model["h"].T
            is_peak = act == peaks[text]  # of equal peaks each takes its share
            shares = np.add.reduceat(is_peak.astype(np.float32), starts)
            da = (df[:, :FILTERS] / count)[text] + is_peak * (df[:, FILTERS:] / shares)[text]
            da = np.where(best > 0, da, 0).astype(np.float32)
            grad["b"] = da.sum(0)
            grad |= {"w0": np.zeros_like(model["w0"]), "w1": np.zeros_like(model["w1"])}
            emb = np.zeros((257, DIM))
            for k in range(0, len(first), PIECE):
                at, g = where[k : k + PIECE], da[k : k + PIECE]
                for name, c in (("w0", cells[at]), ("w1", cells[at + 1])):
                    e = model["emb"][c].reshape(*at.shape, GROUP * DIM)
                    grad[name] += np.einsum("sfd,sf->df", e, g)
                    de = (g[..., None] * model[name].T).reshape(-1, DIM)
                    emb += np.stack([np.bincount(c.ravel(), de[:, i], 257) for i in range(DIM)], 1)
            emb[256] = 0
            grad["emb"] = emb
            for k, g in grad.items():
                moved[k] = 0.9 * moved[k] + 0.1 * g
                squared[k] = 0.999 * squared[k] + 0.001 * g * g
                model[k] = (model[k] - RATE * (moved[k] / (1 - 0.9**step)) / (np.sqrt(squared[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def samples(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[bytes, int]]:
    """At most `rows` labelled documents outside the held-out third, in the order of a hash of the id."""
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (sample_key() != 1))
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "raw")
    return [(bytes(r.raw), r.quality) for r in found.orderBy("doc_id", "raw").limit(rows).collect()]


def score(documents: DataFrame, model: dict) -> DataFrame:
    """documents' doc_id, held_out, score and predicted."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            features = np.array([pool(model, t or b"") for t in texts], np.float32).reshape(len(texts), 2 * FILTERS)
            found = head(model, features).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (sample_key() == 1).alias("held_out"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(documents: DataFrame, model: dict) -> DataFrame:
    """The documents, with all their columns, whose score is at least 0.5."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            features = np.array([pool(model, t or b"") for t in texts], np.float32).reshape(len(texts), 2 * FILTERS)
            yield batch.filter(pa.array(head(model, features).astype(np.float64) >= 0.5))

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    return score(documents, fit(samples(documents, labels, rows)))
