"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a document's bytes in both directions and labels every byte,
white space and digits included; a document's probabilities are the mean over
its bytes. It is trained in numpy by backpropagation through time on passages of
a bounded sample of labelled documents.

Documents are read whole, in windows that run side by side: each direction
starts ``context`` bytes before the bytes that its window labels, so that the
state at a label has read that much text at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.quantiles import quantiles
from millrace.llm.common import byte_slices, settle, settled, sweep, tidy

_PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def encode_passages(passages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and mask, a row for each passage; padded behind."""
    width = max(map(len, passages))
    flat = np.frombuffer(b"".join(passages), dtype=np.uint8)
    mask = np.arange(width) < np.array([len(p) for p in passages])[:, None]
    codes = np.full((len(passages), width), _PAD, dtype=np.int32)
    codes[mask] = flat
    return codes, mask.astype(np.float32)


@dataclass
class ByteGru:
    """Weights by name; ``f_`` reads forwards and ``b_`` backwards."""

    languages: list[str]
    hidden: int = 16
    seed: int = 11
    #: 1 if one more output stands for what is no language
    others: int = 0
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.weights:
            return
        h, random = self.hidden, np.random.default_rng(self.seed)
        for d in "fb":
            self.weights[f"{d}_in"] = random.normal(0, 0.3, (257, 3 * h)).astype(np.float32)
            self.weights[f"{d}_state"] = random.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
            self.weights[f"{d}_bias"] = np.zeros(h, np.float32)
        self.weights["out"] = random.normal(0, h**-0.5, (2 * h, self.outputs)).astype(np.float32)
        self.weights["out_bias"] = np.zeros(self.outputs, np.float32)

    @property
    def outputs(self) -> int:
        return len(self.languages) + self.others

    def _read(self, d: str, codes: np.ndarray, mask: np.ndarray, tape: list | None) -> np.ndarray:
        """The state after each byte; ``tape`` gets what training needs."""
        h, w = self.hidden, self.weights
        table, state, bias = w[f"{d}_in"], w[f"{d}_state"], w[f"{d}_bias"]
        s = np.zeros((len(codes), h), table.dtype)
        out = np.empty((codes.shape[1], len(codes), h), table.dtype)
        steps = range(codes.shape[1])
        for t in steps if d == "f" else reversed(steps):
            x, a = table[codes[:, t]], s @ state
            gates = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            q = a[:, 2 * h :] + bias
            n = np.tanh(x[:, 2 * h :] + r * q)
            m = mask[:, t, None]
            if tape is not None:
                tape.append((t, s, z, r, q, n, m))
            s = s + m * ((1 - z) * (n - s))
            out[t] = s
        return out

    def log_probabilities(self, codes: np.ndarray, mask: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        """Log probability of each language at each byte: (bytes, passages, languages)."""
        both = [self._read(d, codes, mask, None if tapes is None else tapes.setdefault(d, [])) for d in "fb"]
        states = np.concatenate(both, axis=2)
        if tapes is not None:
            tapes["states"] = states
        scores = states @ self.weights["out"] + self.weights["out_bias"]
        scores -= scores.max(axis=2, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=2, keepdims=True))

    def loss_and_gradients(self, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradients through time."""
        tapes: dict = {}
        logs = self.log_probabilities(codes, mask, tapes)
        weight = mask.T[:, :, None] / mask.sum()
        truth = np.eye(self.outputs, dtype=logs.dtype)[labels][None]
        error = (np.exp(logs) - truth) * weight
        h, states, grads = self.hidden, tapes["states"], {}
        grads["out"] = np.einsum("tni,tnl->il", states, error)
        grads["out_bias"] = error.sum(axis=(0, 1))
        back = error @ self.weights["out"].T
        for k, d in enumerate("fb"):
            state = self.weights[f"{d}_state"]
            g_state, g_bias = np.zeros_like(state), np.zeros_like(self.weights[f"{d}_bias"])
            pre = np.empty((codes.shape[1], len(codes), 3 * h), state.dtype)
            ds = np.zeros_like(tapes[d][0][1])
            for t, s, z, r, q, n, m in reversed(tapes[d]):
                ds = ds + back[t][:, k * h : (k + 1) * h]
                dm = ds * m
                dn = dm * (1 - z) * (1 - n * n)
                dz = dm * (s - n) * z * (1 - z)
                dr = dn * q * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                g_state += s.T @ da
                g_bias += (dn * r).sum(axis=0)
                np.concatenate([dz, dr, dn], axis=1, out=pre[t])
                ds = ds * (1 - m) + dm * z + da @ state.T
            g_in = np.zeros_like(self.weights[f"{d}_in"])
            order = np.argsort(codes.T.ravel(), kind="stable")
            seen, starts = np.unique(codes.T.ravel()[order], return_index=True)
            g_in[seen] = np.add.reduceat(pre.reshape(-1, 3 * h)[order], starts, axis=0)
            grads |= {f"{d}_in": g_in, f"{d}_state": g_state, f"{d}_bias": g_bias}
        return float(-(logs * truth * weight).sum()), grads

    def fit(self, passages: list[bytes], labels: np.ndarray, epochs: int = 3, batch: int = 128, rate: float = 0.01, least_steps: int = 200) -> "ByteGru":
        """Adam over seeded batches of passages of similar length.

        Small samples are gone through more often, until ``least_steps`` are made.
        """
        random = np.random.default_rng(self.seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, lengths = 0, np.array([len(p) for p in passages])
        batches = -(-len(passages) // batch)
        epochs = max(epochs, -(-least_steps // batches))
        total = epochs * batches
        for _ in range(epochs):
            order = np.argsort(lengths + random.random(len(passages)) * 16)
            cuts = [order[i : i + batch] for i in range(0, len(order), batch)]
            for k in random.permutation(len(cuts)):
                codes, mask = encode_passages([passages[i] for i in cuts[k]])
                _, grads = self.loss_and_gradients(codes, mask, labels[cuts[k]])
                step += 1
                pace = rate * (1 - 0.9 * step / total)
                for name, g in grads.items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    own = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.weights[name] = (self.weights[name] - pace * own).astype(self.weights[name].dtype)
        return self


class Reader:
    """Runs a network over whole texts, ``together`` windows at a time.

    A window labels up to ``core`` bytes. Memory does not depend on a text's length
    but for the text itself.
    """

    def __init__(self, model: ByteGru, core: int = 256, context: int = 64, together: int = 512):
        self.model, self.core, self.context, self.together = model, core, context, together
        h, w = model.hidden, model.weights
        self.gates = {}
        for d in "fb":
            # a sigmoid is a tanh of half its argument; padding leaves the state as it is
            half, whole = np.float32(0.5), np.float32(1)
            table = w[f"{d}_in"].astype(np.float32) * np.repeat([-half, half, whole], h)
            state = w[f"{d}_state"].astype(np.float32) * np.repeat([-half, half, half], h)
            table[_PAD, :h] = -1e4
            parts = [(np.ascontiguousarray(table[:, i : i + h]), np.ascontiguousarray(state[:, i : i + h])) for i in range(0, 3 * h, h)]
            self.gates[d] = (parts, half * w[f"{d}_bias"].astype(np.float32))

    def _states(self, d: str, codes: np.ndarray) -> np.ndarray:
        """The state after each byte of ``codes`` (steps, windows), in reading order."""
        ((in_z, u_z), (in_r, u_r), (in_n, u_n)), bias = self.gates[d]
        out = np.empty((len(codes), codes.shape[1], self.model.hidden), np.float32)
        s = np.zeros(out.shape[1:], np.float32)
        z, r, n, x = (np.empty_like(s) for _ in range(4))
        for t, c in enumerate(codes):
            # 2 (1 - z) - 1, then 2 r - 1
            np.matmul(s, u_z, out=z)
            z += in_z.take(c, axis=0, out=x, mode="clip")
            np.tanh(z, out=z)
            np.matmul(s, u_r, out=r)
            r += in_r.take(c, axis=0, out=x, mode="clip")
            np.tanh(r, out=r)
            np.matmul(s, u_n, out=n)
            n += bias
            r *= n
            n += r
            n += in_n.take(c, axis=0, out=x, mode="clip")
            np.tanh(n, out=n)
            n -= s
            z *= n
            z += n
            z *= 0.5
            s = np.add(s, z, out=out[t])
        return out

    def _window_sums(self, codes: np.ndarray, widths: np.ndarray) -> np.ndarray:
        """Per window the probabilities summed over the bytes that it labels.

        ``codes`` (windows, context + widest + context) is padded where no text is.
        """
        core = codes.shape[1] - 2 * self.context
        h, side, outputs = self.model.hidden, self.context, self.model.outputs
        steps = codes.T.astype(np.intp)
        forward = self._states("f", steps[: side + core])[side:]
        backward = self._states("b", steps[side:][::-1])[side:][::-1]
        out, bias = self.model.weights["out"].astype(np.float32), self.model.weights["out_bias"].astype(np.float32)
        sums = np.zeros((outputs, len(codes)))
        rows = max(1, (1 << 20) // (len(codes) * outputs))
        for t in range(0, core, rows):
            # a row for each output, so that all steps run along whole rows
            scores = out[:h].T @ forward[t : t + rows].reshape(-1, h).T
            scores += out[h:].T @ backward[t : t + rows].reshape(-1, h).T
            scores += bias[:, None]
            scores -= scores.max(axis=0)
            np.exp(scores, out=scores)
            own = np.arange(t, min(core, t + rows))[:, None] < widths
            scores *= own.ravel() / scores.sum(axis=0)
            sums += scores.reshape(outputs, -1, len(codes)).sum(axis=1)
        return sums.T

    def documents(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each text's mean probability of each language; text ``i`` is ``flat[ends[i] : ends[i + 1]]``.

        Zeros for an empty text.
        """
        sizes = np.diff(ends)
        count = -(-sizes // self.core)
        owner = np.repeat(np.arange(len(sizes)), count)
        # a text's windows are about equally long
        step = -(-sizes // np.maximum(count, 1))
        start = ends[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * step[owner]
        width = np.clip(ends[1:][owner] - start, 0, step[owner])
        sums = np.zeros((len(sizes), self.model.outputs))
        order = np.argsort(-width, kind="stable")
        for i in range(0, len(order), self.together):
            some = order[i : i + self.together]
            core = int(width[some[0]])
            at = start[some, None] + np.arange(-self.context, core + self.context)
            inside = (at >= ends[:-1][owner[some], None]) & (at < ends[1:][owner[some], None])
            codes = np.where(inside, flat[np.clip(at, 0, len(flat) - 1)], np.int16(_PAD))
            np.add.at(sums, owner[some], self._window_sums(codes, width[some]))
        return sums[:, : len(self.model.languages)] / np.maximum(sizes, 1)[:, None]

    def texts(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode("utf-8", "replace") for t in texts]
        return self.documents(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]))


# -- the sample --

#: First letters of scripts from which noise is drawn.
_SCRIPTS = (0x61, 0xE0, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0xE01, 0x3041, 0x4E00, 0xAC00)


def noise(lengths: list[int], seed: int = 5) -> list[bytes]:
    """Passages of letters drawn evenly from one script each, in words: no language."""
    random, out = np.random.default_rng(seed), []
    for i, n in enumerate(lengths):
        first = _SCRIPTS[i % len(_SCRIPTS)]
        letters = first + random.integers(0, 26 if first < 0x4E00 else 5000, n)
        out.append("".join(map(chr, np.where(random.random(n) < 0.16, 0x20, letters))).encode())
    return out


def bucket_of(id: Column, buckets: int) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % buckets


def _passages(text: Column, most: int, chars: int) -> Column:
    """Up to ``most`` passages of ``chars`` characters, spread evenly over the text."""
    size = F.char_length(text)
    count = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(size / chars).cast("int")))
    step = F.greatest(size - chars, F.lit(0)) / F.greatest(count - 1, F.lit(1))
    every = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, (F.floor(i * step) + 1).cast("int"), F.lit(chars)))
    return F.filter(every, lambda p: p.rlike(r"\p{L}"))


def labelled_sample(
    df: DataFrame, id: str, text: str, label: str, wanted: Column, per_language: int, most: int, chars: int
) -> list[tuple[str, list[str]]]:
    """Label and passages of the ``per_language`` documents of least rank of each label.

    The rank is a digest of the id, ties go by the text's hash. Whatever the
    size of the table, only rows up to the bucket of ranks in which a label's
    quota is met are compared. Labels are a vocabulary, and come to the driver.
    """
    rank = F.md5(F.concat(F.lit("language|"), F.col(id).cast("string")))
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(id).isNotNull() & wanted)
    rows = rows.select(rank.alias("rank"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    bucket = F.substring("rank", 1, 3)
    counts = rows.groupBy("label", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = {r.label: r.last for r in counts.withColumn("ahead", ahead).where(F.col("ahead") < per_language).groupBy("label").agg(F.max("bucket").alias("last")).collect()}
    if not last:
        return []
    # from Arrow: rows from a list would start Python workers of another kind, which stay
    limits = df.sparkSession.createDataFrame(pa.table({"label": list(last), "last": list(last.values())}))
    near = rows.join(F.broadcast(limits), "label").where(bucket <= F.col("last"))
    cut = near.select("label", "rank", F.xxhash64("text").alias("tie"), _passages(F.col("text"), most, chars).alias("passages"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("rank", "tie", "passages"))
    found = cut.withColumn("place", place).where(F.col("place") <= per_language).orderBy("label", "place").collect()
    return [(r.label, r.passages) for r in found if r.passages]


def train(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    per_language: int = 500,
    passages: int = 2,
    chars: int = 128,
    hidden: int = 16,
    epochs: int = 3,
    buckets: int = 4,
    held_out: int = 2,
) -> ByteGru | None:
    """The network, fitted on a bounded sample on the driver; None without labels.

    The sample has ``per_language`` documents of each label, none of the held-out
    bucket, and ``passages`` passages of ``chars`` characters of each. As many
    passages of noise as documents teach one more output, so that a text which
    is like no language gets little of any.
    """
    wanted = bucket_of(F.col(id), buckets) != held_out
    found = labelled_sample(df, id, text, label, wanted, per_language, passages, chars)
    if not found:
        return None
    languages = sorted({name for name, _ in found})
    pairs = [(p.encode("utf-8", "replace"), languages.index(name)) for name, own in found for p in own]
    pairs += [(p, len(languages)) for p in noise([len(p) for own in found for p in own[1][:1]])]
    return ByteGru(languages, hidden, others=1).fit([p for p, _ in pairs], np.array([i for _, i in pairs]), epochs)


def least_score(df: DataFrame, model: ByteGru, id: str = "doc_id", text: str = "text", label: str = "lang", buckets: int = 4, held_out: int = 2) -> float:
    """Half of what all but 1 % of held-out documents score, and no more than chance.

    Every labelled held-out document with a letter is scored whole, by ``predict``; the
    share is exact, between two scores in proportion. 0 if there are none. The scores are
    written to the shared folder meanwhile, as a column of their own.
    """
    spark, mark = df.sparkSession, settled()
    rows = df.where(F.col(label).isNotNull() & (bucket_of(F.col(id), buckets) == held_out)).select(F.col(text).alias("text"))
    scores = settle(predict(rows, model).where("lang_pred <> 'und'").select("score"), "held-out-scores")
    found = quantiles(scores, {"score": F.col("score")}, [0.01], in_memory=200_000)["score"]
    sweep(spark, mark, keep=0)
    return min(1 / len(model.languages), 0.5 * found[0]) if found else 0.0


def predict(df: DataFrame, model: ByteGru | None, text: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` added (they replace such columns).

    ``und`` with score 0 if the text is null or has no letter, or without a model.
    """
    base = df.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model) if model else None
        names = np.array([*(model.languages if model else []), "und"], dtype=object)
        for batch in batches:
            for part in byte_slices(batch, text, batch_bytes):
                held = pc.fill_null(part.column(text), "").cast(pa.large_string())
                found = np.zeros((part.num_rows, 1))
                if reader and part.num_rows:
                    _, offsets, body = held.buffers()
                    ends = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1]
                    found = reader.documents(np.frombuffer(body or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0])
                letters = pc.match_substring_regex(held, r"\p{L}").to_numpy(zero_copy_only=False) & (reader is not None)
                pred = np.where(letters, found.argmax(axis=1), len(names) - 1)
                score = np.where(letters, np.minimum(found.max(axis=1), 1.0), 0.0)
                columns = [*part.columns, pa.array(names[pred], pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "score"])

    return base.mapInArrow(tidy(run), schema)


def identify(df: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", buckets: int = 4, held_out: int = 2, **settings) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``df``.

    Learned from the labelled rows whose ``crc32(id as text) mod buckets`` is
    not ``held_out``; only the text decides a prediction. A null or letterless
    text is ``und`` with score 0, as is every text if there are no labels. Rows
    without an id are predicted, never learned from, and not held out. Repeated
    rows come back as they are, and so do rows that repeat an id. Very long
    texts are read whole. Other columns are not read. An empty table gives an
    empty result.
    """
    model = train(df, id, text, label, buckets=buckets, held_out=held_out, **settings)
    out = F.coalesce(bucket_of(F.col(id), buckets) == held_out, F.lit(False))
    rows = df.select(F.col(id).alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model, "text").drop("text")


def keep_identified(df: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", min_score: float | None = None, **settings) -> DataFrame:
    """``df`` without the documents that are ``und`` or score below ``min_score``.

    Same columns, whatever their names. The limit is read from held-out scores
    where it is not given, see ``least_score``. Null, empty and letterless texts
    are ``und``. Without any label there is nothing to learn from, and all rows
    stay. Repeated rows stay or go together; rows without an id are judged like
    others. An empty table gives an empty one.
    """
    columns = df.columns
    model = train(df, id, text, label, **settings)
    if model is None:
        return df
    limit = least_score(df, model, id, text, label) if min_score is None else min_score
    marked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    kept = predict(marked, model, f"c{columns.index(text)}").where((F.col("lang_pred") != "und") & (F.col("score") >= limit))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
