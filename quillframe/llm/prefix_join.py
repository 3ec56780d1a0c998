"""Operator 9: similarity join on word shingles by grouped prefixes.

Two documents link when the Jaccard similarity of their sets of 5-word shingles (words
lower-cased A-Z; a shorter text is one shingle; no words: an empty set, linked with
nothing) is at least ``percent``.

1. Documents with equal sets are a class; only its smallest doc_id goes on.
2. Shingles are ordered rarest first, by the number of classes that hold them (its bit
   length) and then by hash.  Linked sets share one of their first n - ceil(t n) + 1
   shingles; shingles of a single class can't be it, so a class whose prefix holds only
   such has no partner and drops out.
3. Classes of one size and one prefix form a group.  Groups meet under the shingles of their
   prefixes, in blocks, and pairs of groups are filtered (``group_pairs``); only then the
   members of the pairs left are fetched and compared, block by block (``verified``), so a
   shingle, group or leader that a third of all rows share is work for many tasks.
4. Links make components.  Members are first compared with their group, and groups with
   the leaders most of their shingles name (linear; a leader has few rarer shingles): pairs
   inside one component need no comparison, as no link between them could change it.  All
   other pairs come under 3; nothing is capped.

Rows of one doc_id are one node, whatever their order and texts; null ids count as the smallest
and come back as null (an id of -2^63 is taken for null).  Null and empty texts have no words.
Texts of any length are one set each, in the memory of one task.  An empty table gives no
rows.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from quillframe.llm.common import LOWER, U64, Words, drop_stored, release, store
from quillframe.llm.components import components
from quillframe.llm.packed import Distinct, Texts, answer, ask, cut, meet, pack, parse, partitions

SHINGLE, PERCENT = 5, 80
BITS = 2048  # of a bitmap of a set: a bit for each value of the top bits of its hashes
SIDE, MEMBERS, STAR = 512, 16, 128  # groups of a block, members of a group, partners of a leader compared at once
WIDE = 4096  # columns of a matrix
NO_ID = -(1 << 63)
_KEY = np.dtype([("low", "<u4"), ("high", "u1")])
_PAIR = np.dtype([("digest", "V16"), ("id", "<i8")])


def sets_of(t: Texts, k: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each document of a block."""
    words = Words(LOWER[t.buf], t.offs)
    at, h = words.windows(k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        at, h = np.concatenate([at, words.first[short]]), np.concatenate([h, words.whole(short)])
    doc = np.searchsorted(words.first, at, "right") - 1
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]
    h, doc = h[new], doc[new]
    ends = np.searchsorted(doc, np.arange(len(words.count) + 1))
    return [h[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Block:
    """A block's sets, their digests, and after the first answers each one's class."""

    def __init__(self, t: Texts, k: int, parts: int, answers: dict[int, bytes] | None = None):
        self.ids = t.ids
        self.sets = sets_of(t, k)
        self.full = np.array([len(s) > 0 for s in self.sets], bool)
        digests: dict[bytes, int] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                d = xxhash.xxh3_128_digest(s.tobytes())
                digests[d] = min(digests.get(d, int(t.ids[i])), int(t.ids[i]))
        names = sorted(digests)
        self.named = np.zeros(len(names), _PAIR)
        self.named["digest"] = np.frombuffer(b"".join(names), "V16") if names else np.zeros(0, "V16")
        self.named["id"] = [digests[n] for n in names]
        top = np.array([int.from_bytes(n[:8], "big") for n in names], U64)
        self.ends = cut(top, parts)
        if answers is None:
            return
        best = np.concatenate([np.frombuffer(answers[p], "<i8") for p in np.flatnonzero(self.ends[1:] > self.ends[:-1]).tolist()] or [np.zeros(0, np.int64)])
        of = dict(zip(names, best.tolist(), strict=True))
        self.rep = np.array([of[xxhash.xxh3_128_digest(s.tobytes())] if len(s) else int(t.ids[i]) for i, s in enumerate(self.sets)], np.int64)
        seen: set[bytes] = set()
        self.leads = []  # documents that stand for their class
        for i, s in enumerate(self.sets):
            if len(s) and self.rep[i] == t.ids[i] and (key := xxhash.xxh3_128_digest(s.tobytes())) not in seen:
                seen.add(key)
                self.leads.append(i)
        self.tokens = Distinct(np.concatenate([self.sets[i] for i in self.leads]) if self.leads else np.zeros(0, U64))
        self.token_ends = cut(self.tokens.values, parts)


def classes_and_prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Stored rows: (rid, n, doc_ids) of every class in every block; (rid, n, first, alone, prefix, items, bits) of classes that may have partners (alone: shingles of this class only)."""
    table = pack(docs.select("doc_id", "text"), "join-docs")
    parts = partitions(table)

    def name(t: Texts, _):
        b = _Block(t, k, parts)
        for p in np.flatnonzero(b.ends[1:] > b.ends[:-1]).tolist():
            yield p, b.named[b.ends[p] : b.ends[p + 1]].tobytes()

    def smallest(bodies):
        out: dict[bytes, int] = {}
        rows = [np.frombuffer(x, _PAIR) for x in bodies]
        for r in rows:
            for d, i in zip(r["digest"].tolist(), r["id"].tolist(), strict=True):
                out[d] = min(out.get(d, i), i)
        return [np.array([out[d] for d in r["digest"].tolist()], "<i8").tobytes() for r in rows]

    reps = answer(ask(table, name, parts), smallest, parts, "classes")

    def count(t: Texts, answers):
        b = _Block(t, k, parts, answers)
        d = b.tokens
        key = np.empty(len(d.values), _KEY)
        key["low"], key["high"] = d.values & U64(0xFFFFFFFF), (d.values >> U64(32)) & U64(0xFF)
        size = np.minimum(d.size, 255).astype(np.uint8)
        for p in np.flatnonzero(b.token_ends[1:] > b.token_ends[:-1]).tolist():
            own = slice(b.token_ends[p], b.token_ends[p + 1])
            yield p, key[own].tobytes() + size[own].tobytes()

    def rarity(bodies):
        counts = [len(x) // 6 for x in bodies]
        pairs = np.concatenate([np.frombuffer(x, _KEY, n) for n, x in zip(counts, bodies, strict=True)])
        size = np.concatenate([np.frombuffer(x, np.uint8, n, 5 * n) for n, x in zip(counts, bodies, strict=True)]).astype(np.int64)
        d = Distinct(pairs["low"].astype(U64) | (pairs["high"].astype(U64) << U64(32)))
        held = np.add.reduceat(size[d.order], d.at)
        level = d.spread(np.frexp(held)[1].astype(np.uint8))  # bit length: 1 for one class, 2 for two or three ...
        ends = np.cumsum([0, *counts])
        return [level[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    levels = answer(ask((table, reps), count, parts), rarity, parts, "rarity", shift=parts)

    def prefixes(groups):
        for _, body, answers in groups:
            b = _Block(Texts(parse(body)), k, parts, {p: a for p, a in answers.items() if p < parts})
            level = np.concatenate([np.frombuffer(answers[parts + p], np.uint8) for p in np.flatnonzero(b.token_ends[1:] > b.token_ends[:-1]).tolist()] or [np.zeros(0, np.uint8)])
            level = b.tokens.spread(level)
            rid, n, members, first, alone, prefix, bodies, marks = [], [], [], [], [], [], [], []
            by: dict[tuple[int, int], list] = {}
            for i, s in enumerate(b.sets):
                by.setdefault((int(b.rep[i]), len(s)), []).append(int(b.ids[i]))
            for (r, size), ids in by.items():
                rid.append(r), n.append(size), members.append(ids), first.append(None), alone.append(None), prefix.append(None), bodies.append(None), marks.append(None)
            at = 0
            for i in b.leads:
                s = b.sets[i]
                own = level[at : at + len(s)]
                at += len(s)
                length = len(s) - -(-percent * len(s) // 100) + 1
                if int((own == 1).sum()) >= length:
                    continue
                alone.append(int((own == 1).sum()))
                order = np.lexsort((s, own))[:length]
                order = order[own[order] > 1]
                rid.append(int(b.ids[i])), n.append(len(s)), members.append(None), first.append(length)
                prefix.append(s[order].view(np.int64)), bodies.append(s.view(np.int64))
                flags = np.zeros(BITS, np.uint8)
                flags[s >> U64(64 - BITS.bit_length() + 1)] = 1
                marks.append(np.packbits(flags).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(n, pa.int64()), pa.array(members, pa.list_(pa.int64())), pa.array(first, pa.int64()), pa.array(alone, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bodies, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))],
                names=["rid", "n", "doc_ids", "first", "alone", "prefix", "items", "bits"],
            )

    out = store(meet(table, reps.unionByName(levels), prefixes, "rid long, n long, doc_ids array<long>, first long, alone long, prefix array<long>, items array<long>, bits array<long>"), "prefixes")
    table.drop()
    for x in (reps, levels):
        drop_stored(x)
    release(docs.sparkSession)
    return out


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of left with every set of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    if not len(x) or not len(y):
        return out
    names = np.unique(y)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    met = np.flatnonzero(names[at] == x)
    if not len(met):
        return out
    used = np.zeros(len(names), bool)
    used[at[met]] = True
    column = np.cumsum(used) - 1
    row_x, col_x = np.repeat(np.arange(len(left)), [len(v) for v in left])[met], column[at[met]]
    at = np.searchsorted(names, y)
    met = np.flatnonzero(used[at])
    row_y, col_y = np.repeat(np.arange(len(right)), [len(v) for v in right])[met], column[at[met]]
    width = int(column[-1]) + 1
    for lo in range(0, width, WIDE):
        hi = min(width, lo + WIDE)
        a, b = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
        for m, row, col in ((a, row_x, col_x), (b, row_y, col_y)):
            own = slice(None) if width <= WIDE else np.flatnonzero((col >= lo) & (col < hi))
            m[row[own], col[own] - lo] = 1
        out += a @ b.T
    return out


def _lists(column) -> list[np.ndarray]:
    """The lists of a column as views; None for nulls."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    here = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [values[a:b] if v else None for a, b, v in zip(ends[:-1].tolist(), ends[1:].tolist(), here, strict=True)]


def _units(batches, keys: list[str]):
    """Consecutive rows of one key (they come sorted by it), as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(new), batch.num_rows).tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield last, pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.concat_batches(held)


def verified(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the labels, if they differ, of sets of either side of one unit that link, of rows(u1, u2, u3, right, rid, label).

    A unit's sets are compared with one another at once, so a set travels once a unit.
    """
    keys = ["u1", "u2", "u3"]

    def run(batches):
        for _, unit in _units(batches, keys):
            right = unit.column("right").to_numpy(zero_copy_only=False)
            items, label = _lists(unit.column("items")), unit.column("label").to_numpy()
            size = np.array([len(x) for x in items])
            y = np.flatnonzero(right)
            found = set()
            for lo in range(0, unit.num_rows, STAR):
                x = lo + np.flatnonzero(~right[lo : lo + STAR])
                if not len(x) or not len(y):
                    continue
                same = common([items[k] for k in x.tolist()], [items[k] for k in y.tolist()]).astype(np.int64)
                i, j = np.nonzero((100 * same >= percent * (size[x][:, None] + size[y][None, :] - same)) & (label[x][:, None] != label[y][None, :]))
                found.update(zip(label[x][i].tolist(), label[y][j].tolist(), strict=True))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    whole = rows.join(sets.select("rid", "items"), "rid").select(*keys, "right", "label", "items")
    return whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) those that link; a b with many partners meets them STAR at a time."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    placed = pairs.join(parts, "b").select(F.col("b").alias("u1"), F.expr("pmod(xxhash64(a), parts)").alias("u2"), F.lit(0).alias("u3"), "a")
    hubs = placed.select("u1", "u2", "u3", F.lit(True).alias("right"), F.col("u1").alias("rid")).distinct()
    rows = placed.select("u1", "u2", "u3", F.lit(False).alias("right"), F.col("a").alias("rid")).unionByName(hubs)
    return verified(rows.withColumn("label", F.col("rid")), sets, percent)


def group_pairs(index: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """(u1, u2, u3, a, b, a_parts, b_parts): the pairs of groups that may hold a link.

    index(token, gid, n, key, place, k, m, low, high): a row for each shingle of a group's prefix;
    group(gid, n, key, prefix, bits).  Groups meet under each shingle.  One of more than SIDE groups is
    cut into bands of like sizes and those into blocks, and every two blocks of one or of
    neighbouring bands are a unit, so it is worked off by many tasks.  A pair passes at its first common
    shingle only, if

    * its members are not all of one component already,
    * sizes allow the similarity,
    * the places of that shingle leave enough of both sets behind it,
    * the prefixes have enough in common: the overlap wanted less what lies behind either, and
    * (groups of one member) the bitmaps leave room for the overlap: a bit that one has and the
      other lacks is a shingle not in common at least.

    A group of several components meets itself, at its first shingle.
    """
    keys = ["token", "band", "pair"]
    band = F.floor(F.log("n") / (-np.log(percent / 100) * (1 + 1e-9))).cast("int")  # sets that link lie in one band or in neighbours
    placed = index.withColumn("band", band)
    parts = placed.groupBy("token", "band").agg(F.count(F.lit(1)).alias("groups"), F.min("low").alias("low"), F.max("high").alias("high"))
    bands = parts.groupBy("token").agg(F.sum("groups").alias("groups"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("groups") / SIDE).cast("int")))).alias("parts"), F.min("low").alias("least"), F.max("high").alias("most"))
    several = "m > 1 and low <> high and k = 0"
    whole = placed.join(bands.where("least <> most").drop("least", "most"), "token").where(f"groups > 1 or {several}")
    whole = whole.withColumn("own", F.expr("cast(pmod(xxhash64(gid, key), parts[band]) as int)"))
    # (band of the unit, its two blocks, side 0 / 1 / both); neighbouring bands: twice the lower band, plus one
    units = whole.withColumn(
        "unit",
        F.explode(
            F.expr(
                f"case when groups <= {SIDE} then array(named_struct('band', -1, 'pair', 0L, 'side', 2)) else"
                " concat(transform(sequence(0, parts[band] - 1), x -> named_struct('band', 2 * band, 'pair', shiftleft(cast(least(x, own) as bigint), 32) + greatest(x, own), 'side', case when x = own then 2 when own < x then 0 else 1 end)),"
                " case when parts[band + 1] is null then array() else transform(sequence(0, parts[band + 1] - 1), x -> named_struct('band', 2 * band + 1, 'pair', shiftleft(cast(own as bigint), 32) + x, 'side', 0)) end,"
                " case when parts[band - 1] is null then array() else transform(sequence(0, parts[band - 1] - 1), x -> named_struct('band', 2 * band - 1, 'pair', shiftleft(cast(x as bigint), 32) + own, 'side', 1)) end) end"
            )
        ),
    ).select("token", "unit.band", "unit.pair", "unit.side", "gid", "n", "key", "place", "k", "m", "low", "high")
    units = units.join(group.select("gid", "n", "key", "prefix", "bits"), ["gid", "n", "key"])

    def pairs(unit):
        side = unit.column("side").to_numpy()
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(x) or not len(y):
            return None
        n, place, k, m, low, high = (unit.column(c).to_numpy().astype(np.int64) for c in ("n", "place", "k", "m", "low", "high"))
        left = n - place
        ok = (100 * n[x][:, None] >= percent * n[y]) & (100 * n[y] >= percent * n[x][:, None])
        ok &= (100 + percent) * np.minimum(left[x][:, None], left[y]) >= percent * (n[x][:, None] + n[y])
        ok &= np.minimum(low[x][:, None], low[y]) != np.maximum(high[x][:, None], high[y])
        alone = np.zeros(0, np.int64)
        if side[0] == 2:
            ok &= np.arange(len(x))[:, None] < np.arange(len(y))
            alone = np.flatnonzero((m > 1) & (low != high) & (k == 0))
        i, j = np.nonzero(ok)
        if len(i):
            prefix = _lists(unit.column("prefix"))
            a, b = np.unique(i), np.unique(j)
            i, j = np.searchsorted(a, i), np.searchsorted(b, j)
            a, b = x[a], y[b]
            before = common([prefix[r][: k[r]] for r in a.tolist()], [prefix[r][: k[r]] for r in b.tolist()])
            behind = common([prefix[r][k[r] :] for r in a.tolist()], [prefix[r][k[r] :] for r in b.tolist()])
            sizes, most = n[a][i] + n[b][j], np.maximum(n[a][i], n[b][j])
            keep = (before[i, j] == 0) & (behind[i, j] >= percent * sizes / (100 + percent) - np.ceil(percent * most / 100) + 0.999)
            i, j = a[i[keep]], b[j[keep]]
        if len(i):
            here = unit.column("bits").is_valid().to_numpy(zero_copy_only=False)
            bits = np.zeros((len(here), BITS // 64), np.uint64)
            flat = unit.column("bits").drop_null().flatten().to_numpy().view(np.uint64)
            bits[here] = flat.reshape(-1, BITS // 64)
            keep = np.ones(len(i), bool)
            for lo in range(0, len(i), 4096):
                u, v = i[lo : lo + 4096], j[lo : lo + 4096]
                over = [n[p] - np.bitwise_count(bits[p] & ~bits[q]).sum(1, dtype=np.int64) for p, q in ((u, v), (v, u))]
                keep[lo : lo + 4096] = ~(here[u] & here[v]) | ((100 + percent) * np.minimum(*over) >= percent * (n[u] + n[v]))
            i, j = i[keep], j[keep]
        i, j = np.append(i, alone), np.append(j, alone)
        if not len(i):
            return None
        gid, of = unit.column("gid").to_numpy(), -(-m // MEMBERS)
        return gid[i], gid[j], of[i], of[j]

    def run(batches):
        for key, unit in _units(batches, keys):
            got = pairs(unit)
            if got is not None:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(got[0]), v, np.int64)) for v in key), *(pa.array(c) for c in got)], names=["u1", "u2", "u3", "a", "b", "a_parts", "b_parts"])

    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u1 long, u2 long, u3 long, a long, b long, a_parts long, b_parts long")


def link_components(sets: DataFrame, percent: int = PERCENT, rounds: int = 2) -> DataFrame:
    """(node, component) of the classes in sets(rid, n, first, alone, prefix, items, bits) that have a link."""
    t = percent / 100
    grouped = sets.select("rid", "n", "alone", "prefix", "bits", F.xxhash64("n", "prefix").alias("key"))
    group = store(
        grouped.groupBy("n", "key", "prefix").agg(F.min_by("rid", F.struct("alone", "rid")).alias("gid"), F.min("alone").alias("alone"), F.count(F.lit(1)).alias("m"), F.first("bits").alias("bits")).withColumn("bits", F.expr("if(m = 1, bits, null)")),
        "groups",
    )  # groups of one doc_id with several texts share a gid, so a group is known by (gid, n, key)
    members = store(grouped.select("rid", "n", "key").join(group.where("m > 1").select("n", "key", "gid"), ["n", "key"], "left").select("rid", F.coalesce("gid", "rid").alias("gid")), "members", False)
    # a shingle's place in its set: those of the class alone come first, then the prefix as stored
    tokens = store(group.select("gid", "n", "key", "m", F.posexplode("prefix").alias("k", "token"), "alone").select("gid", "n", "key", "m", "token", "k", (F.col("alone") + F.col("k")).alias("place")), "tokens", False)
    # the rarest common shingle of two sets that link lies so far in front that what follows in either set can still be the overlap wanted
    near = lambda a, b: f"{100 + percent} * least({a}n - {a}place, {b}n - {b}place) >= {percent} * ({a}n + {b}n)"
    links = store(stars(members.where("rid <> gid").select(F.col("rid").alias("a"), F.col("gid").alias("b")), sets, percent), "links", False)
    found = components(links)
    for r in range(rounds):
        mark = tokens.join(found, tokens.gid == found.node, "left").select("gid", "n", "place", "token", F.coalesce("component", "gid").alias("component"), F.floor(F.log("n") / -np.log(t) + (r % 2) / 2).alias("band"))
        # leaders are typical: where others have this shingle late, few of theirs are rarer; three of them, others each round
        lead = F.struct("gid", "n", "place", "component")
        ranks = [F.struct(F.floor(10 * F.col("place") / F.col("n")), F.xxhash64("gid", F.lit(3 * r + k))) for k in range(3)]
        leads = mark.groupBy("token", "band").agg(F.array_distinct(F.array(*[F.min_by(lead, rank) for rank in ranks])).alias("leads"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        votes = mark.join(leads.select("token", "band", F.explode("leads").alias("lead")), ["token", "band"]).where("component <> lead.component").where(near("", "lead.")).groupBy("gid", F.col("lead.gid").alias("lead")).agg(F.count(F.lit(1)).alias("votes"))
        # the three that most of a group's shingles name
        best = store(votes.groupBy("gid").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "lead")), asc=False), 1, 3).alias("best")).select(F.col("gid").alias("a"), F.explode("best.lead").alias("b")), "leaders", False)
        more = store(stars(best, sets, percent), "more-links", False)
        drop_stored(best)
        if more.isEmpty():
            drop_stored(more)
            continue
        links = store(links.unionByName(more), "links", False)
        found = components(links)
    where = store(members.join(found, members.rid == found.node, "left").select("rid", "gid", F.coalesce("component", "rid").alias("component")), "where", False)
    spread = where.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    met = store(group_pairs(tokens.join(spread, "gid"), group, percent), "group-pairs")
    side = lambda s, o, right: met.select("u1", "u2", "u3", F.col(s).alias("gid"), F.col(f"{s}_parts").alias("parts"), F.col(f"{o}_parts").alias("others"), F.lit(right).alias("right"))
    ends = side("a", "b", False).unionByName(side("b", "a", True)).groupBy("u1", "u2", "u3", "gid", "right").agg(F.max("parts").alias("parts"), F.max("others").alias("others"))
    widest = F.max("others").over(Window.partitionBy("u1", "u2", "u3", "right"))
    ends = ends.withColumn("others", widest).withColumn("other", F.explode(F.expr("sequence(0, others - 1)")))
    rows = ends.join(where, "gid").withColumn("part", F.expr("pmod(xxhash64(rid), parts)"))
    rows = rows.select("u1", F.xxhash64("u2", "u3").alias("u2"), F.expr("if(right, shiftleft(other, 32) + part, shiftleft(part, 32) + other)").alias("u3"), "right", "rid", F.col("component").alias("label"))
    last = store(verified(rows, sets, percent).distinct(), "last-links")  # one link between two components joins them
    out = found if last.isEmpty() else components(links.unionByName(last))
    for x in (group, members, tokens, links, where, met, last):
        drop_stored(x)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    found = classes_and_prefixes(docs, shingle, percent)
    sets = found.where("items is not null").select("rid", "n", "first", "alone", "prefix", "items", "bits")
    nodes = link_components(sets, percent)
    rows = found.where("doc_ids is not null").select("rid", "n", "doc_ids").join(nodes.withColumnRenamed("node", "rid"), "rid", "left")
    rows = rows.select(F.explode("doc_ids").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rid").alias("component_id"))
    return rows.select(F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), "n_shingles", F.expr(f"nullif(component_id, {NO_ID})").alias("component_id"))
