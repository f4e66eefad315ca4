"""Operator 7: language identification by a bidirectional gated recurrent network over bytes.

One gated recurrent network runs forwards over a text's bytes and one backwards; at every
byte their states give a distribution over languages, and a document's probabilities
are the mean over all its bytes. Both run across words. A long text is read in
stretches that overlap: each byte is labelled in one stretch, and the bytes around a
stretch only bring the states up to where it begins. The network is trained in numpy
by backpropagation through time on stretches drawn from the whole texts of a
bounded sample of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a stretch that are labelled, and bytes before and after it that are only read.
STRETCH, AROUND = 448, 32
UNDETERMINED = "und"


@dataclass(frozen=True)
class Training:
    """rows: bound of the sample, in equal shares for all languages, but one document of each at least. chars: of a longer document, so many characters from a place drawn by its id. length, batch, steps: of the fit."""

    rows: int = 1000
    chars: int = 1 << 16
    length: int = 96
    hidden: int = 12
    steps: int = 500
    batch: int = 96
    rate: float = 0.015
    seed: int = 7


class ByteGru:
    """Parameters by name; suffix f is the forward network, b the backward one.

    x: what each byte adds to the gates (update, reset) and to the candidate; u: what the state adds; v: from
    state to languages. Gates are (1 + tanh) / 2.
    """

    def __init__(self, languages: list[str], hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": draw(256, 3 * hidden), f"u{d}": draw(hidden, 3 * hidden), f"v{d}": draw(hidden, len(languages))}
        self.p["c"] = np.zeros(len(languages), np.float32)

    def _run(self, d: str, data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """State after each byte of ``data`` (length, rows), with what backpropagation needs."""
        H, x, u = self.hidden, self.p[f"x{d}"], self.p[f"u{d}"]
        h = np.zeros((data.shape[1], H), np.float32)
        out = []
        for at in data:
            a, b = x[at], h @ u
            g = np.tanh(a[:, : 2 * H] + b[:, : 2 * H]) * np.float32(0.5) + np.float32(0.5)
            z, r = g[:, :H], g[:, H:]
            c = np.tanh(a[:, 2 * H :] + r * b[:, 2 * H :])
            new = c + z * (h - c)
            out.append((new, h, z, r, c, b[:, 2 * H :]))
            h = new
        return out

    def _logits(self, d: str, data: np.ndarray) -> np.ndarray:
        """(length, languages, rows): what one network adds at every byte. Rows lie along the second axis, so gates are whole blocks."""
        H, x, u, v = self.hidden, self.p[f"x{d}"].T.copy(), self.p[f"u{d}"].T.copy(), self.p[f"v{d}"].T.copy()
        length, n = data.shape
        u[2 * H :] *= 0.5  # a gate is (1 + g) / 2: here the half of the reset gate is taken beforehand
        h, out = np.zeros((H, n), np.float32), np.empty((length, len(v), n), np.float32)
        a, b = np.empty((3 * H, n), np.float32), np.empty((3 * H, n), np.float32)
        g, c, update, reset = a[: 2 * H], b[2 * H :], a[:H], a[H : 2 * H]
        for t in range(length):
            x.take(data[t], 1, a)
            np.matmul(u, h, b)
            g += b[: 2 * H]
            np.tanh(g, g)
            g += 1
            c *= reset
            c += a[2 * H :]
            np.tanh(c, c)
            h -= c
            h *= update
            h *= 0.5
            h += c
            np.matmul(v, h, out[t])
        return out

    def sums(self, stretches: list[tuple[bytes, int, int]]) -> np.ndarray:
        """Summed probabilities of each stretch (bytes, first and end of those that are labelled)."""
        n = len(stretches)
        lengths = np.array([len(s) for s, _, _ in stretches])
        longest = int(lengths.max())
        data = np.zeros((n, longest), np.uint8)
        held = np.arange(longest)[None, :] < lengths[:, None]
        data[held] = np.frombuffer(b"".join(s for s, _, _ in stretches), np.uint8)
        place = np.where(held, lengths[:, None] - 1 - np.arange(longest)[None, :], 0)
        turned = np.take_along_axis(data, place, 1)
        s = self._logits("f", np.ascontiguousarray(data.T))
        s += self._logits("b", np.ascontiguousarray(turned.T))[place.T, :, np.arange(n)[None, :]].transpose(0, 2, 1)
        s += self.p["c"][:, None]
        s -= s.max(1, keepdims=True)
        np.exp(s, s)
        s /= s.sum(1, keepdims=True)
        first, end = (np.array([x[i] for x in stretches]) for i in (1, 2))
        t = np.arange(longest)[:, None]
        return np.einsum("tln,tn->nl", s, ((t >= first) & (t < end)).astype(np.float32))

    def gradient(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions of ``data`` (rows, length) and its gradient, through time in both directions."""
        n, length = data.shape
        H = self.hidden
        ways = {"f": data.T, "b": data.T[::-1]}
        runs = {d: self._run(d, way) for d, way in ways.items()}
        states = {d: np.stack([x[0] for x in run])[:: 1 if d == "f" else -1] for d, run in runs.items()}  # by position
        s = states["f"] @ self.p["vf"] + states["b"] @ self.p["vb"] + self.p["c"]
        e = np.exp(s - s.max(2, keepdims=True))
        q = e / e.sum(2, keepdims=True)
        rows = np.arange(n)
        loss = -float(np.log(q[:, rows, target] + 1e-9).mean())
        q[:, rows, target] -= 1
        q /= n * length
        g = {"c": q.sum((0, 1))}
        for d in "fb":
            g[f"v{d}"] = np.tensordot(states[d], q, ((0, 1), (0, 1)))
            back = (q @ self.p[f"v{d}"].T)[:: 1 if d == "f" else -1]
            u, dh = self.p[f"u{d}"], np.zeros((n, H), np.float32)
            da_all, db_all, h_all = (np.empty((length, n, k), np.float32) for k in (3 * H, 3 * H, H))
            for t in range(length - 1, -1, -1):
                _, h, z, r, c, uc = runs[d][t]
                dh = dh + back[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z) * 2
                dr = dc * uc * r * (1 - r) * 2
                da = np.concatenate([dz, dr, dc], 1)
                db = np.concatenate([dz, dr, dc * r], 1)
                da_all[t], db_all[t], h_all[t] = da, db, h
                dh = dh * z + db @ u.T
            g[f"u{d}"] = np.tensordot(h_all, db_all, ((0, 1), (0, 1)))
            at, flat = ways[d].reshape(-1), da_all.reshape(-1, 3 * H)
            g[f"x{d}"] = np.stack([np.bincount(at, flat[:, j], 256) for j in range(3 * H)], 1).astype(np.float32)
        return loss, g


def fit(texts: list[bytes], target: np.ndarray, languages: list[str], t: Training) -> ByteGru:
    """Train on texts (their languages in ``target``): a step draws languages evenly, then bytes of theirs with equal chances.

    Texts of one language follow each other where a stretch crosses an end, as do the beginnings where it is shorter than ``t.length``.
    """
    net, rng = ByteGru(languages, t.hidden, t.seed), np.random.default_rng(t.seed)
    joined = []
    for k in range(len(languages)):
        data = np.frombuffer(b"\n".join(x for x, y in zip(texts, target.tolist()) if y == k), np.uint8)
        joined.append(np.resize(data, max(len(data), t.length)) if len(data) else None)
    known = np.array([k for k, x in enumerate(joined) if x is not None])
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, t.steps + 1):
        y = known[rng.integers(0, len(known), t.batch)]
        at = [int(rng.integers(0, len(joined[k]) - t.length + 1)) for k in y]
        _, g = net.gradient(np.stack([joined[k][a : a + t.length] for k, a in zip(y, at)]), y)
        rate = t.rate * min(1.0, 2 * (1 - step / (t.steps + 1)))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in net.p.items():
            d = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d**2
            x -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def stretches(data: bytes) -> list[tuple[bytes, int, int]]:
    """Overlapping stretches of a text, each with the first and the end of the bytes that are labelled in it."""
    out = []
    for a in range(0, len(data), STRETCH):
        first, end = max(0, a - AROUND), min(len(data), a + STRETCH)
        out.append((data[first : end + AROUND], a - first, end - first))
    return out


def means(net: ByteGru, texts: list[bytes], rows: int = 1024) -> np.ndarray:
    """Mean probabilities over the bytes of each text (zeros where it has none)."""
    total = np.zeros((len(texts), len(net.languages)))
    parts = [(i, s) for i, x in enumerate(texts) for s in stretches(x)]
    parts.sort(key=lambda p: len(p[1][0]))
    for a in range(0, len(parts), rows):
        some = parts[a : a + rows]
        np.add.at(total, [i for i, _ in some], net.sums([s for _, s in some]))
    return total / np.maximum([[len(x)] for x in texts], 1)


_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def learn(df: DataFrame, t: Training = Training(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteGru | None:
    """Fit on a sample of about ``t.rows`` documents with non-null id, text and language; None without any.

    The sample, drawn by a hash of the id, has about as many documents of each language, and at least the one with the least hash; the driver holds at most ``t.chars`` characters of each.
    """
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    draw = F.pmod(F.xxhash64("id", F.lit(t.seed)), F.lit(1_000_000)) / 1_000_000
    counts = rows.where("text <> ''").groupBy("lang").agg(F.count("*").alias("n"), F.min(draw).alias("least"))
    n = counts.count()
    if not n:
        return None
    few = F.broadcast(counts) if n <= 10_000 else counts  # else a language's texts would meet in one task
    spare = F.length("text") - t.chars
    part = F.when(spare > 0, F.substring("text", F.pmod(F.xxhash64("id"), spare + 1).cast("int") + 1, F.lit(t.chars))).otherwise(F.col("text"))
    sample = rows.join(few, "lang").where((draw * F.col("n") * n < t.rows) | (draw == F.col("least"))).select("id", "lang", part.alias("text")).collect()
    sample = sorted((r for r in sample if r.text), key=lambda r: (r.lang, str(r.id), r.text))
    languages = sorted({r.lang for r in sample})
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    return fit([r.text.encode() for r in sample], np.array([number[r.lang] for r in sample]), languages, t)


def identify(df: DataFrame, net: ByteGru | None, keep: list[str], text_col: str = "text", batch_chars: int = 2 << 20) -> DataFrame:
    """``keep`` columns with lang_pred and score, the mean probability of that language over all bytes.

    Null texts, and those without a letter, give ``und`` and 0; so does everything without a network.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(net)
    names = [c for c in keep if c not in ("lang_pred", "score")]
    source = df.select(*names, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = df.select(*names).schema.add("lang_pred", "string").add("score", "double")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found: list[tuple[str, float]] = []
            first = 0
            while first < len(texts):
                part, size = [], 0
                while first < len(texts) and size < batch_chars:
                    part.append(texts[first].as_py())
                    size += len(part[-1])
                    first += 1
                mean = means(net, [x.encode() for x in part]) if net else None
                for i, text in enumerate(part):
                    if mean is None or not has_letter(text):
                        found.append((UNDETERMINED, 0.0))
                    else:
                        best = int(np.argmax(mean[i]))
                        found.append((net.languages[best], float(min(1.0, mean[i, best]))))
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(read, schema)


def held_out_languages(df: DataFrame, t: Training = Training(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    Documents whose crc32(id as text) mod 3 is 1 are held out: the network never sees them. A null id is
    neither held out nor learned from. Repeated rows give repeated results; an empty table gives none.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    net = learn(df.where(~out), t, id_col, text_col, lang_col)
    marked = df.select(F.col(id_col), F.col(text_col)).withColumn("held_out", out)
    return identify(marked, net, [id_col, "held_out"], text_col)
