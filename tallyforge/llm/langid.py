"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are cut into windows of ``steps`` bytes (all of a text, none left out); the network reads a window in both
directions, labels every byte position with language probabilities, and a document's probabilities are the mean
over its positions. Windows of many documents run side by side as lanes of one matrix, so memory is bounded
by ``lanes`` x ``steps`` and a long text is no special case.

Training takes at most ``docs_per_lang`` documents of each language (the smallest hashes of their ids), at most
``windows_per_doc`` windows of each: the documented bound of the labelled sample. All languages are learned, unless ``max_langs`` is given. A chosen row
without a text teaches nothing. Prediction sees the text alone.

Defined results: null text, or text without a letter, gives ``und`` with score 0. If there is nothing to learn
from, every row is ``und``. Each row gives one row, repeated ids too, each by its own text. Equally probable languages: the first by name.
Scores are rounded to six decimals, as sums of floats hang on which texts run side by side. Of rows with one id and language the one with the smallest
windows is learned from. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAD = 256  # a step behind the end of a text


def init_model(langs: list[str], hidden: int = 8, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    m: dict = {"langs": list(langs), "hidden": hidden}
    for d in ("f", "b"):
        m["X" + d] = rng.normal(0, 0.3, (PAD + 1, 3 * hidden)).astype(np.float32)  # input weights and bias by byte
        m["U" + d] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
    m["O"] = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32)
    m["c"] = np.zeros((len(langs), 1), np.float32)
    return m


def _sig(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _run(X, U, codes, hidden, keep=False):
    """Hidden states of each step of ``codes`` (steps x lanes); with ``keep`` also what the backward pass needs."""
    steps, lanes = codes.shape
    h = np.zeros((hidden, lanes), np.float32)
    hs, saved = np.empty((steps, hidden, lanes), np.float32), []
    for t in range(steps):
        x = X[codes[t]].T
        u = U @ h
        zr = _sig(x[: 2 * hidden] + u[: 2 * hidden])
        z, r = zr[:hidden], zr[hidden:]
        n = np.tanh(x[2 * hidden :] + r * u[2 * hidden :])
        if keep:
            saved.append((h, z, r, n, u[2 * hidden :]))
        h = n + z * (h - n)
        hs[t] = h
    return hs, saved


def position_probs(m: dict, codes: np.ndarray) -> np.ndarray:
    """Language probabilities (steps x langs x lanes) of each byte position."""
    H = m["hidden"]
    f, _ = _run(m["Xf"], m["Uf"], codes, H)
    b, _ = _run(m["Xb"], m["Ub"], codes[::-1], H)
    y = np.matmul(m["O"][:, :H], f) + np.matmul(m["O"][:, H:], b[::-1]) + m["c"]
    y -= y.max(axis=1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=1, keepdims=True)
    return y


def _back(U, saved, dhs, hidden):
    """Backpropagation through time: gradients of the inputs (steps x 3 hidden x lanes) and of U."""
    dU = np.zeros_like(U)
    dxs = [None] * len(saved)
    dh = np.zeros_like(dhs[0])
    for t in range(len(saved) - 1, -1, -1):
        h, z, r, n, un = saved[t]
        dh = dh + dhs[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        du = np.concatenate([dz, dr, dn * r])
        dxs[t] = np.concatenate([dz, dr, dn])
        dU += du @ h.T
        dh = dh * z + U.T @ du
    return dxs, dU


def loss_and_grads(m: dict, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over positions, and its gradients."""
    H, (steps, lanes) = m["hidden"], codes.shape
    f, sf = _run(m["Xf"], m["Uf"], codes, H, True)
    b, sb = _run(m["Xb"], m["Ub"], codes[::-1], H, True)
    b = b[::-1]
    y = np.matmul(m["O"][:, :H], f) + np.matmul(m["O"][:, H:], b) + m["c"]
    y -= y.max(axis=1, keepdims=True)
    p = np.exp(y)
    p /= p.sum(axis=1, keepdims=True)
    real = (codes != PAD)[:, None, :].astype(np.float32)
    count = max(1.0, float(real.sum()))
    lane = np.arange(lanes)
    loss = float(-(np.log(p[:, labels, lane] + 1e-12) * real[:, 0]).sum() / count)
    d = p.copy()
    d[:, labels, lane] -= 1
    d *= real / np.float32(count)
    g = {"O": np.concatenate([np.einsum("tkl,thl->kh", d, f), np.einsum("tkl,thl->kh", d, b)], axis=1), "c": d.sum(axis=(0, 2))[:, None]}
    for name, saved, dh, order in (("f", sf, np.matmul(m["O"][:, :H].T, d), codes), ("b", sb, np.matmul(m["O"][:, H:].T, d)[::-1], codes[::-1])):
        dxs, g["U" + name] = _back(m["U" + name], saved, dh, H)
        gx = np.zeros_like(m["X" + name])
        np.add.at(gx, order.ravel(), np.concatenate([x.T for x in dxs]))
        g["X" + name] = gx
    return loss, g


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = 8, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 5) -> dict:
    """Fit by Adam. ``windows``: lanes x steps of byte codes."""
    m, rng = init_model(langs, hidden, seed), np.random.default_rng(seed)
    names = ("Xf", "Uf", "Xb", "Ub", "O", "c")
    mean, var, at = {k: np.zeros_like(m[k]) for k in names}, {k: np.zeros_like(m[k]) for k in names}, 0
    total = epochs * max(1, -(-len(windows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            _, g = loss_and_grads(m, np.ascontiguousarray(windows[pick].T), labels[pick])
            at += 1
            step = rate * (1 - at / (total + 1))
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k in names:
                x = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * x
                var[k] = 0.99 * var[k] + 0.01 * x * x
                m[k] = (m[k] - step * (mean[k] / (1 - 0.9**at)) / (np.sqrt(var[k] / (1 - 0.99**at)) + 1e-6)).astype(np.float32)
    return m


def codes_of(data: bytes, steps: int) -> np.ndarray:
    """All windows of ``data``: lanes x steps."""
    n = -(-len(data) // steps)
    out = np.full(n * steps, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, steps)


def predict_texts(m: dict, texts: list, steps: int = 64, lanes: int = 4096) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not m or not m["langs"]:
        return names, scores
    k = len(m["langs"])
    sums, sizes = np.zeros((len(texts), k)), np.zeros(len(texts))
    pend: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held = 0

    def flush():
        nonlocal held
        codes, own = np.concatenate(pend), np.concatenate(owner)
        for i in range(0, len(codes), lanes):
            c, o = np.ascontiguousarray(codes[i : i + lanes].T), own[i : i + lanes]
            p = position_probs(m, c)
            p *= (c != PAD)[:, None, :]
            total = p.sum(axis=0)
            for j in range(k):
                sums[:, j] += np.bincount(o, total[j], len(texts))
        pend.clear(), owner.clear()
        held = 0

    for i, t in enumerate(texts):
        if t is None or not any(map(str.isalpha, t)):
            continue
        data = t.encode("utf-8", "surrogatepass")
        sizes[i] = len(data)
        for at in range(0, len(data), steps * lanes):
            w = codes_of(data[at : at + steps * lanes], steps)
            pend.append(w), owner.append(np.full(len(w), i))
            held += len(w)
            if held >= lanes:
                flush()
    if held:
        flush()
    for i in np.flatnonzero(sizes):
        j = int(np.argmax(sums[i]))
        names[i], scores[i] = m["langs"][j], round(float(min(1.0, max(0.0, sums[i, j] / sizes[i]))), 6)
    return names, scores


def fit(labelled: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", docs_per_lang=400, windows_per_doc=8, steps=64, hidden=8, epochs=6, seed=5, max_langs=None) -> dict:
    """Train on a bounded sample: per language the ``docs_per_lang`` rows of smallest id hash, ``windows_per_doc`` windows each.

    All languages are learned; ``max_langs`` keeps the most common ones only.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("h"), F.col(text_col).cast("string").alias("t"))
    # counts and choice read ids and languages only; a hash threshold by language leaves about four times the sample, so that no task ranks a whole language
    common = rows.groupBy("l").count()
    common = (common.orderBy(F.desc("count"), "l").limit(max_langs) if max_langs else common).collect()  # a row a language, as the model has
    if not common:
        return {}
    shares = F.create_map(*[F.lit(x) for r in common for x in (r["l"], min(1.0, 4.0 * docs_per_lang / r["count"]))])
    keys = rows.select("l", "h").where(F.pmod("h", F.lit(1_000_000_000)) < F.try_element_at(shares, F.col("l")) * 1_000_000_000)
    chosen = keys.distinct().withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h"))).where(F.col("r") <= docs_per_lang).select("l", "h")
    text_col, rows = "t", rows.where("t IS NOT NULL").join(F.broadcast(chosen) if len(common) <= 1000 else chosen, ["l", "h"], "left_semi")  # docs_per_lang keys a language at most
    size = F.length(text_col)
    span = F.greatest(size - steps, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.lit(windows_per_doc - 1)), lambda j: F.substring(F.col(text_col), F.floor(span * j / max(1, windows_per_doc - 1)).cast("int") + 1, F.lit(steps)))
    sample = rows.select("l", "h", F.array_distinct(starts).alias("w")).groupBy("l", "h").agg(F.min("w").alias("w"))
    got = sorted(sample.collect(), key=lambda r: (r["h"], r["l"]))
    langs = sorted({r["l"] for r in got})
    data = [(codes_of(w.encode("utf-8")[:steps], steps)[0], langs.index(r["l"])) for r in got for w in r["w"] if any(map(str.isalpha, w))]
    if not data:
        return {}
    return train(np.array([x for x, _ in data]), np.array([y for _, y in data]), langs, hidden, epochs, seed=seed)


def predict(docs: DataFrame, model: dict, id_col="doc_id", text_col="text", steps=64, lanes=4096) -> DataFrame:
    """(doc_id, lang_pred, score), one row for each row of ``docs``."""

    def run(batches):
        for b in batches:
            names, scores = predict_texts(model, b.column(1).to_pylist(), steps, lanes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col="doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, model: dict, text_col="text", min_score=0.3, steps=64, lanes=4096) -> DataFrame:
    """``docs`` without rows whose language is not known: ``und``, or a score under ``min_score``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            names, scores = predict_texts(model, b.column(at).to_pylist(), steps, lanes)
            yield b.filter(pa.array([n != "und" and s >= min_score for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
