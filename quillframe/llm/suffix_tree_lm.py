"""Operator 4: scoring by a probabilistic suffix tree over words.

Tokens are the words of a text (A-Z lower-cased), then one end.  A state is a context of
the last 0, 1 .. ``depth`` words.  Training texts give counts of every token and of every
(context, next token) whose context occurs ``least`` times or more.  A context is kept if
its next tokens diverge from those of the longest kept suffix of it: the leave-one-out
log-likelihood ratio a token,

    1/n sum_w c(w) ln( (c(w) - 1 + L p(w)) / (n - 1 + L) / p(w) )   with p of that suffix,

must reach ``divergence``.  A kept context's distribution is smoothed towards its suffix's:
(c(w) + L p(w)) / (n + L).  The root is (c + 0.1) / (N + 0.1 (V + 1)).  A token's probability
is that of the longest kept context before it, so every state's probabilities sum to one.

Counting is done by packed questions (see ``packed``).  What is packed is not text but its tokens,
each a number among the hashes of the block's distinct ones, so words are found and hashed once, not
at every depth; counts travel compressed.  Contexts go to the partition of
their hash, except those with a ``1/hot`` share of all tokens or more: there are at most
``hot`` of them a depth, their next tokens are dealt out over all partitions, and only their
sums (one row each) come to the driver.  Probabilities travel as 16-bit
logarithms in steps of 12/65535 of a decade, or more if 1 / (N + L) is below 1e-11: no token
seen after its context is less likely than that.  Of tokens never seen there only n + L
travels, and the block puts it to its own L p(w), so there is no least probability.

Null texts are empty: one end token.  Repeated rows count and are scored each, whatever their ids.
A very long text is a block of its own; an empty table gives no rows; columns other than doc_id and
text are ignored.  Without
training texts N and V are 0 and every token has the same base probability.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillframe.llm.common import LOWER, U64, Words, mix, release
from quillframe.llm.packed import Distinct, answer, ask, bits, cut, dump, meet, pack, parse, partitions, unbits

DEPTH, LEAST, DIVERGENCE, PRIOR, HOT = 4, 32, 0.02, 200.0, 4000
END = U64(0x5851F42D4C957F2D)
SUMS = -7  # part of the rows that carry a partition's sums
_STEPS, _DECADES = 65535, 12


def planes(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Integers byte plane by byte plane: the many zero bytes then compress away."""
    x = x.astype(kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(body: bytes, n: int, at: int = 0, kind: str = "<u8") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


_ZSTD = pa.Codec("zstd")


def squeeze(*bodies: bytes) -> bytes:
    """Bodies end to end, compressed, after their length."""
    raw = b"".join(bodies)
    return len(raw).to_bytes(4, "little") + _ZSTD.compress(raw, asbytes=True)


def unsqueeze(body: bytes, at: int = 0) -> bytes:
    return _ZSTD.decompress(memoryview(body)[at + 4 :], int.from_bytes(body[at : at + 4], "little"), asbytes=True)


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


class Tree:
    """What a block needs of the model so far: totals, and each depth's frequent contexts."""

    def __init__(self, parts: int):
        self.parts, self.total, self.kinds, self.shift = parts, 0, 0, 0.0
        self.frequent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # per depth from 1: hashes, n, kept

    def level(self, counts: np.ndarray) -> np.ndarray:
        """Of token sequences: 0 rare, 1 a context, 2 a frequent one."""
        return (counts >= LEAST).astype(np.int8) + (counts >= max(LEAST, self.total / HOT))

    @property
    def step(self) -> float:
        return max(_DECADES, self.shift + 1) / _STEPS

    def root(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.kinds + 1)))


class _Level:
    """The (context, next) pairs of one depth in a block, and where each goes.  ctx: of each place of at its context's hash."""

    def __init__(self, b: _Block, at: np.ndarray, ctx: np.ndarray, hot: np.ndarray, parts: int):
        self.at = at
        nxt = b.token[at]
        to = ctx.copy()
        to[hot] = mix(ctx[hot] ^ (nxt[hot] >> U64(1)))
        # one key sorts by partition, context and next token; should two pairs share it, one may be named twice, which the sums bear
        order = np.argsort((to & ~U64(0xFFFFFF)) | (nxt >> U64(40)))
        c, x = ctx[order], nxt[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (x[1:] != x[:-1])))[: len(c)]
        self.first = np.flatnonzero(new)
        self.group = np.empty(len(order), np.int32)
        self.group[order] = np.cumsum(new, dtype=np.int32) - 1  # of each place its pair
        lead = order[self.first]
        self.ctx, self.next, self.hot, self.lead = ctx[lead], nxt[lead], hot[lead], at[lead]
        self.ends = cut(to[lead], parts)
        self.order = order

    def count(self, train: np.ndarray) -> np.ndarray:
        """Of each pair: how often it occurs in training texts."""
        return np.add.reduceat(train[self.at[self.order]].astype(np.int64), self.first) if len(self.first) else np.zeros(0, np.int64)


def tokens(batch: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> bytes:
    """A block of texts as one row: ids and numbers of tokens of its documents, hashes of its distinct tokens, and of each place which it is."""
    words = Words(LOWER[buf], offs)
    size = words.count + 1
    token = np.full(int(size.sum()), END, U64)
    token[np.arange(len(words)) + np.repeat(np.arange(len(size)), words.count)] = words.hash
    d = Distinct(token)
    which = d.spread(np.arange(len(d.values), dtype=np.uint32))
    ids = batch.column("doc_id")
    listed = [pa.LargeListArray.from_arrays([0, len(x)], x) for x in (ids, pa.array(size, pa.int64()), pa.array(d.values, pa.uint64()))]
    return dump(pa.RecordBatch.from_arrays([*listed, pa.array([planes(which, "<u4")], pa.large_binary())], names=["doc_id", "size", "words", "which"]))


class _Block:
    def __init__(self, packed: pa.RecordBatch):
        self.ids, size, words = (packed.column(k).flatten() for k in ("doc_id", "size", "words"))
        self.size, self.words = size.to_numpy(), words.to_numpy()
        n = len(self.size)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.which = unplanes(packed.column("which")[0].as_buffer(), int(self.first[-1]), kind="<u4")
        self.token = self.words[self.which]
        self.held = np.array([held_out(i) for i in self.ids.to_pylist()], bool)
        self.train = np.repeat(~self.held, self.size)
        self.place = np.arange(len(self.token), dtype=np.int32) - np.repeat(self.first[:-1], self.size).astype(np.int32)

    def walk(self, tree: Tree, answers: dict[int, bytes], depth: int):
        """Counts of the tokens, log10 probability by contexts below ``depth``, and the pairs to ask about at ``depth``."""
        parts = tree.parts
        ends = cut(self.words, parts)
        count = np.concatenate([unplanes(unsqueeze(answers[p]), int(ends[p + 1] - ends[p])) for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist()]).astype(np.int64)
        logp = tree.root(count)[self.which]
        state, ctx = tree.level(count)[self.which], np.zeros(len(self.token), U64)
        for d in range(1, depth + 1):
            # states: 1 where the d tokens before a place are a context to ask about, 2 where a frequent one; all of them had one at d - 1
            at = np.flatnonzero((state[:-1] > 0) & (self.place[1:] >= d)) + 1
            ctx[at] = mix((ctx[at] + U64(d)) * U64(0xFF51AFD7ED558CCD) ^ self.token[at - d])
            level = _Level(self, at, ctx[at], state[at - 1] > 1, parts)
            if d == depth:
                break
            kept, value, seen = np.zeros(len(level.first), bool), np.zeros(len(level.first)), np.zeros(len(level.first), np.int8)
            unseen = np.zeros(len(level.first), bool)
            for p in np.flatnonzero(level.ends[1:] > level.ends[:-1]).tolist():
                a, z = level.ends[p], level.ends[p + 1]
                body = answers[d * parts + p]
                n = int(z - a)
                flags = unbits(body, 4 * n).reshape(4, n)
                kept[a:z] = flags[0]
                seen[a:z] = flags[1].view(np.int8) + flags[2]
                unseen[a:z] = flags[3]
                value[a:z][flags[0]] = -tree.step * np.frombuffer(body, "<u2", offset=(4 * n + 7) // 8)
            names, totals, keep = tree.frequent[d - 1]
            if level.hot.any():
                where = np.searchsorted(names, level.ctx[level.hot])
                kept[level.hot] = keep[where]
                value[level.hot] += np.where(unseen[level.hot], 0.0, tree.shift) - np.log10(totals[where] + PRIOR)
            value[unseen] += np.log10(PRIOR) + logp[level.lead[unseen]]
            mine = kept[level.group]
            logp[at[mine]] = value[level.group[mine]]
            state = np.zeros(len(self.token), np.int8)
            state[at] = seen[level.group]
        return count, logp, level


def _totals(replies: DataFrame) -> list[tuple[int, float, float]]:
    """Sums by key of the partitions' rows: one a partition set at depth 0, at most HOT a depth later."""

    def run(batches):
        for b in batches:
            x = np.array([np.frombuffer(v, "<f8") for v in b.column("body").to_pylist()]).reshape(b.num_rows, 2)
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["key", "x", "y"])

    return [tuple(r) for r in replies.where(F.col("part") == SUMS).select("block", "body").mapInArrow(run, "key long, x double, y double").groupBy("key").agg(F.sum("x"), F.sum("y")).collect()]


def score(docs: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE) -> DataFrame:
    """The contract's columns for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    table = pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "tree-docs", tokens)
    parts = partitions(table)
    tree = Tree(parts)

    def words(b: _Block, _):
        ends = cut(b.words, parts)
        seen = np.bincount(b.which, weights=b.train, minlength=len(b.words)).astype(np.int64)
        for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            a, z = ends[p], ends[p + 1]
            yield p, np.array([z - a], "<u4").tobytes() + b.words[a:z].tobytes() + squeeze(planes(seen[a:z]))

    def count(bodies):
        sizes = [int(np.frombuffer(x, "<u4", 1)[0]) for x in bodies]
        d = Distinct(np.concatenate([np.frombuffer(x, np.uint8, 8 * n, 4) for n, x in zip(sizes, bodies, strict=True)]).view(U64))
        seen = np.concatenate([unplanes(unsqueeze(x, 4 + 8 * n), n) for n, x in zip(sizes, bodies, strict=True)]).astype(np.int64)
        total = np.add.reduceat(seen[d.order], d.at)
        out, ends = d.spread(total), np.cumsum([0, *sizes])
        return [squeeze(planes(out[a:z])) for a, z in zip(ends[:-1], ends[1:], strict=True)], [(0, float(total.sum()), float((total > 0).sum()))]

    replies = answer(ask(table, words, parts, _Block), count, parts, "tree-0", sums=SUMS)
    for _, x, y in _totals(replies):
        tree.total, tree.kinds, tree.shift = int(x), int(y), float(np.log10(x + PRIOR))
    learnt = [replies]
    for d in range(1, depth + 1):
        known = learnt[0]
        for x in learnt[1:]:
            known = known.unionByName(x)
        held = spark.sparkContext.broadcast(tree)

        def pairs(b: _Block, answers, d=d, held=held):
            _, logp, level = b.walk(held.value, answers, d)
            seen = level.count(b.train)
            scaled = np.clip(np.round(-logp[level.lead] / held.value.step), 1, _STEPS).astype("<u2")
            for p in np.flatnonzero(level.ends[1:] > level.ends[:-1]).tolist():
                a, z = level.ends[p], level.ends[p + 1]
                ctx = level.ctx[a:z]
                at = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
                runs = np.diff(np.append(at, z - a))
                head = np.array([z - a, len(at)], "<u4").tobytes()
                nxt = (level.next[a:z] >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                yield p, b"".join([head, ctx[at].tobytes(), nxt, squeeze(planes(runs, "<u4"), planes(seen[a:z], "<u4"), planes(scaled[a:z], "<u2"), bits(level.hot[a:z]))])

        def test(bodies, held=held):
            heads = [np.frombuffer(x, "<u4", 2).tolist() for x in bodies]
            ends = np.cumsum([0, *(n for n, _ in heads)])
            ctx, nxt, seen, scaled, hot = (np.empty(ends[-1], t) for t in (U64, U64, np.uint32, np.uint16, bool))
            for x, (n, m), a, z in zip(bodies, heads, ends[:-1], ends[1:], strict=True):
                rest = unsqueeze(x, 8 + 8 * m + 5 * n)
                ctx[a:z] = np.repeat(np.frombuffer(x, U64, m, 8), unplanes(rest, m, 0, "<u4"))
                wide = np.zeros((n, 8), np.uint8)
                wide[:, :5] = np.frombuffer(x, np.uint8, 5 * n, 8 + 8 * m).reshape(n, 5)
                nxt[a:z] = wide.view(U64).ravel()
                seen[a:z], scaled[a:z] = unplanes(rest, n, 4 * m, "<u4"), unplanes(rest, n, 4 * m + 4 * n, "<u2")
                hot[a:z] = unbits(memoryview(rest)[4 * m + 6 * n :], n)
            order = np.lexsort((nxt, ctx))
            ctx = ctx[order]
            new_ctx = np.concatenate(([True], ctx[1:] != ctx[:-1]))
            nxt = nxt[order]
            at = np.flatnonzero(new_ctx | np.concatenate(([True], nxt[1:] != nxt[:-1])))
            size = np.diff(np.append(at, len(ctx)))
            ctx, top = ctx[at], np.flatnonzero(new_ctx[at])
            del nxt, new_ctx
            total = np.add.reduceat(seen[order], at, dtype=np.int64)
            lead = order[at]
            back = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
            back[order] = np.repeat(np.arange(len(at), dtype=back.dtype), size)
            del order, seen, size
            p = 10.0 ** (-held.value.step * scaled[lead])
            n = np.add.reduceat(total, top)
            each = np.diff(np.append(top, len(at)))
            gain = total * np.log(np.maximum(total - 1 + PRIOR * p, 1e-300) / p)
            gain[total == 0] = 0
            gain = np.add.reduceat(gain, top)
            open_ = hot[lead[top]]
            kept = (n > 1) & ((gain - n * np.log(np.maximum(n - 1 + PRIOR, 1e-9))) >= divergence * n)
            unseen = total == 0  # their p may be less than what can travel
            value = np.where(unseen, 0.0, np.log10(total + PRIOR * p)) - np.repeat(np.where(open_, 0.0, np.log10(n + PRIOR)), each)
            show = np.repeat(kept | open_, each)
            out = []
            level = held.value.level(total)
            # of frequent contexts the value lacks their n: log10 of counts, moved below 0 by the largest count there can be
            value -= np.where(unseen, 0.0, np.repeat(np.where(open_, held.value.shift, 0.0), each))
            scaled = np.clip(np.round(-value / held.value.step), 0, _STEPS).astype("<u2")
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                g = back[a:z]
                out.append(bits(np.concatenate([show[g], level[g] > 0, level[g] > 1, unseen[g]])) + scaled[g][show[g]].tobytes())
            names = ctx[top][open_].view(np.int64)
            return out, list(zip(names.tolist(), n[open_].tolist(), gain[open_].tolist(), strict=True))

        replies = answer(ask((table, known.where(F.col("part") >= 0)), pairs, parts, _Block), test, parts, f"tree-{d}", shift=d * parts, sums=SUMS)
        rows = _totals(replies)
        names = np.array([r[0] for r in rows], np.int64).view(U64)
        n, gain = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        order = np.argsort(names)
        keep = (gain - n * np.log(np.maximum(n - 1 + PRIOR, 1e-9))) >= divergence * n
        tree.frequent.append((names[order], n[order], keep[order]))
        learnt.append(replies)
        release(spark)
    known = learnt[0]
    for x in learnt[1:]:
        known = known.unionByName(x)
    held = spark.sparkContext.broadcast(tree)

    def total(groups):
        tree = held.value
        for _, body, answers in groups:
            b = _Block(parse(body))
            count, logp, _ = b.walk(tree, answers, depth + 1)
            sums = lambda x: np.add.reduceat(x, b.first[:-1]) if len(b.size) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.ids, pa.array(b.held), pa.array(b.size), pa.array(sums((count > 0).astype(np.int64)[b.which])), pa.array(np.full(len(b.size), tree.total, np.int64)), pa.array(sums(tree.root(count)[b.which])), pa.array(sums(logp))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return meet(table, known.where(F.col("part") >= 0), total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
