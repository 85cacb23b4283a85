"""The trie of conversations' prefixes: which beginnings are shared, and what sharing them saves.

Turns are sorted by range of (conversation, turn), so a conversation of any length is spread. A numpy
scan gives every prefix a polynomial rolling fingerprint; since such fingerprints of neighbouring pieces
can be put together, each range is scanned alone and gets from the driver one carry, the piece of the
conversation that it continues. Prefixes of one depth and fingerprint are a candidate group. Each group
is verified turn by turn: the last texts of its members are held against its representative's (that of
the smallest conversation). By induction over the depth that compares whole prefixes, as with equal
last texts equal fingerprints have equal fingerprints before them. Members that differ are split off
under a mark of the depth, and all is grouped and verified again until no group has two texts.
Parents then get what their subtrees hold: each node is counted by its smallest conversation, summed
along that conversation to the end, and then over the members of each node.

forks name conversations that begin with the first turns of another one: the fingerprints of both are
put together, so no text is copied for that.

Defined cases: a null turn stands first; equal turns go by a hash of role and text, and rows that are
all equal are several turns; null roles and texts are empty; rows without a conv_id are left out; a fork
of a conversation that does not exist, or that is shorter, takes what there is; an empty table gives no
nodes, not even a root; very long texts are hashed and compared whole; other columns are ignored. Rows of
one conversation and turn that agree in two 64-bit hashes count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attest.llm.shared import cut, firsts, shared_folder, small_batches, written

KEY = ("depth", "fp", "marks")
_FIRST = -(1 << 63)
#: Ids of a block that is hashed at a time, and rows of a conversation that are summed at a time.
BLOCK = 8192


@dataclass(frozen=True)
class Settings:
    """Fingerprints are two residues of a prime below 2**31. A small prime makes many collisions."""

    prime: int = (1 << 31) - 1
    bases: tuple[int, int] = (1_146_403_091, 739_391_137)

    def inverse(self, k: int) -> int:
        return pow(self.bases[k], -1, self.prime)


def _power(base: int, e: np.ndarray, p: int) -> np.ndarray:
    """base ** e modulo p, for an array of exponents."""
    out, b, e = np.ones(len(e), np.uint64), base % p, e.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * np.uint64(b) % np.uint64(p), out)
        b, e = b * b % p, e >> np.uint64(1)
    return out


class _Scan:
    """Rolling fingerprints of rows that come sorted by conversation, in batches."""

    def __init__(self, s: Settings, carry: tuple[int, int, int, int] | None = None):
        self.s = s
        #: (conversation, its turns so far, its two residues) at the end of what was read.
        self.state = carry
        #: The same for the conversation that came first, once another follows.
        self.first: tuple[int, int, int, int] | None = None

    def batch(self, conv: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(places, from 1; residues) of the rows; places and residues go on from the state."""
        p, begin = np.uint64(self.s.prime), firsts(conv)
        length = np.diff(np.append(begin, len(conv)))
        nth = np.arange(len(conv)) - np.repeat(begin, length) + 1
        goes_on = self.state is not None and self.state[0] == conv[0]
        held = self.state[1:] if goes_on else (0, 0, 0)
        residues = []
        for k, base in enumerate(self.s.bases):
            term = hashes % p * _power(self.s.inverse(k), nth, self.s.prime) % p
            total = np.cumsum(term)
            total -= np.repeat(total[begin] - term[begin], length)
            start = np.zeros(len(begin), np.uint64)
            start[0] = held[1 + k]
            residues.append((np.repeat(start, length) + total) % p * _power(base, nth, self.s.prime) % p)
        place = nth.copy()
        place[: length[0]] += held[0]
        if self.first is None and self.state is not None and not goes_on:
            self.first = self.state
        if self.first is None and len(begin) > 1:
            self.first = (int(conv[0]), int(place[begin[1] - 1]), *(int(r[begin[1] - 1]) for r in residues))
        self.state = (int(conv[-1]), int(place[-1]), *(int(r[-1]) for r in residues))
        return place, residues


def _carries(ranged: DataFrame, s: Settings) -> dict[int, tuple[int, int, int, int]]:
    """What each range continues: one small row a range goes over the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, part = _Scan(s), None
        for b in batches:
            if b.num_rows:
                part = b.column("p")[0].as_py()
                scan.batch(b.column("conv_id").to_numpy(), b.column("h").to_numpy().view(np.uint64))
        if part is not None:
            one = scan.first is None
            row = [part, one, *(scan.state if one else scan.first), *scan.state]
            yield pa.RecordBatch.from_pylist([{f"c{i}": int(x) for i, x in enumerate(row)}])

    got = ranged.select("p", "conv_id", "h").mapInArrow(ends, ", ".join(f"c{i} long" for i in range(10))).collect()
    out, state = {}, None
    for part, one, *both in sorted(map(tuple, got)):
        first, last = both[:4], both[4:]
        goes_on = state is not None and state[0] == first[0]
        if goes_on:
            out[part] = tuple(state)
        if one and goes_on:
            grown = [(state[2 + k] * pow(base, first[1], s.prime) + first[2 + k]) % s.prime for k, base in enumerate(s.bases)]
            state = [first[0], state[1] + first[1], *grown]
        else:
            state = last
    return out


def _identified(turns: DataFrame) -> DataFrame:
    """conv_id, t, role and text without nulls, and two hashes of role and text."""
    t = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return t.select("*", F.xxhash64("role", "text").alias("h"), F.xxhash64("text", "role", F.lit(1)).alias("g"))


def fingerprints(turns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(conv_id, t, h, g, chars, place, fp, up, down): each turn's place, and its prefix's fingerprint.

    up and down are the powers of the bases, and of their inverses, to the place.
    """
    slim = _identified(turns).select("conv_id", "t", "h", "g", F.length("text").alias("chars"))
    order = ("conv_id", "t", "h", "g")
    ranged = cut(slim.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("p", F.spark_partition_id())
    carries = _carries(ranged, s)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = held or _Scan(s, carries.get(b.column("p")[0].as_py()))
            place, fp = held.batch(b.column("conv_id").to_numpy(), b.column("h").to_numpy().view(np.uint64))
            up = [_power(base, place, s.prime) for base in s.bases]
            down = [_power(s.inverse(k), place, s.prime) for k in (0, 1)]
            packed = [pa.array((x[0] << np.uint64(31) | x[1]).view(np.int64)) for x in (fp, up, down)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*order, "chars")), pa.array(place), *packed], names=[*order, "chars", "place", "fp", "up", "down"])

    rows = ranged.mapInArrow(scan, "conv_id long, t long, h long, g long, chars int, place long, fp long, up long, down long")
    return written(rows, f"{shared_folder(turns.sparkSession)}/fingerprints")


def _residues(c: Column) -> list[Column]:
    return [F.shiftright(c, 31), c.bitwiseAND((1 << 31) - 1)]


def _packed(parts: list[Column]) -> Column:
    return F.shiftleft(parts[0], 31).bitwiseOR(parts[1])


def _mod(c: Column, s: Settings) -> Column:
    return F.pmod(c, F.lit(s.prime))


def _plans(rows: DataFrame, forks: DataFrame | None, s: Settings) -> DataFrame:
    """For each conversation: its length, how many turns it takes from another, and what changes its fingerprints.

    A turn at place i goes to depth i + shift, and its fingerprint grows by change times up.
    """
    size = rows.groupBy("conv_id").agg(F.max("place").alias("len"))
    if forks is None:
        return size.select("*", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("base"), F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("change"))
    f = forks.where("base <> conv_id and taken > 0")
    f = f.join(size.select(F.col("conv_id").alias("base"), F.col("len").alias("there")), "base", "left").withColumn("got", F.least("taken", F.coalesce("there", F.lit(0))).cast("long")).drop("there")
    theirs = rows.select(F.col("conv_id").alias("base"), F.col("place").alias("got"), F.col("fp").alias("theirs"))
    mine = rows.select("conv_id", F.col("place").alias("taken"), F.col("fp").alias("mine"), "down")
    f = f.join(theirs, ["base", "got"], "left").join(mine, ["conv_id", "taken"], "left")
    parts = [_mod((a - b) * d, s) for a, b, d in zip(*(_residues(F.coalesce(c, F.lit(0).cast("long"))) for c in ("theirs", "mine", "down")), strict=True)]
    f = f.select("conv_id", "base", F.col("taken").cast("long").alias("taken"), "got", _packed(parts).alias("change"))
    zero = F.lit(0).cast("long")
    return size.join(f, "conv_id", "left").select("conv_id", "len", F.coalesce("taken", zero).alias("taken"), "base", F.coalesce("got", zero).alias("got"), F.coalesce("change", zero).alias("change"))


def _members(rows: DataFrame, plans: DataFrame, s: Settings) -> DataFrame:
    """(conv_id, depth, fp, h, chars, ends, own, t, g): a row for each conversation and prefix, the root included."""
    sums = [_mod(a + b * c, s) for a, b, c in zip(*(_residues(F.col(c)) for c in ("fp", "change", "up")), strict=True)]
    own = rows.join(plans, "conv_id").where("place > taken")
    own = own.select("conv_id", (F.col("place") - F.col("taken") + F.col("got")).alias("depth"), _packed(sums).alias("fp"), "h", "chars", (F.col("place") == F.col("len")).alias("ends"), F.lit(True).alias("own"), "t", "g")
    most = plans.agg(F.max("got")).first()[0] or 0
    head = rows.where(F.col("place") <= most).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "fp", "h", "chars")
    head = plans.where("got > 0").join(head, "base").where("depth <= got")
    none = F.lit(None).cast("long")
    head = head.select("conv_id", "depth", "fp", "h", "chars", ((F.col("depth") == F.col("got")) & (F.col("len") <= F.col("taken"))).alias("ends"), F.lit(False).alias("own"), none.alias("t"), none.alias("g"))
    zero = F.lit(0).cast("long")
    root = plans.select("conv_id", zero.alias("depth"), zero.alias("fp"), zero.alias("h"), F.lit(0).alias("chars"), ((F.col("got") == 0) & (F.col("len") <= F.col("taken"))).alias("ends"), F.lit(False).alias("own"), none.alias("t"), none.alias("g"))
    return own.unionByName(head).unionByName(root)


def _marked(members: DataFrame, plans: DataFrame, failed: list[DataFrame]) -> DataFrame:
    """members with marks: the depths, one for each round, at which their path was split off."""
    if not failed:
        return members.withColumn("marks", F.lit(""))
    f = reduce(DataFrame.unionByName, failed).groupBy("conv_id").agg(F.sort_array(F.collect_list("depth")).alias("at"))  # one a round at most
    p = plans.join(f, "conv_id", "left").join(f.select(F.col("conv_id").alias("base"), F.col("at").alias("theirs")), "base", "left")
    none = F.array().cast("array<long>")
    both = F.concat(F.filter(F.coalesce("theirs", none), lambda d: d <= F.col("got")), F.filter(F.coalesce("at", none), lambda d: d > F.col("got")))
    p = p.select("conv_id", F.when(F.col("base").isNull(), F.coalesce("at", none)).otherwise(both).alias("at"))
    return members.join(p, "conv_id").withColumn("marks", F.array_join(F.filter("at", lambda d: d <= F.col("depth")), ",")).drop("at")


def _nodes(members: DataFrame, s: Settings) -> DataFrame:
    """The groups by depth, fingerprint and marks, with the group that each goes on from."""
    n = members.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.sum(F.col("own").cast("long")).alias("n_own"), F.min("h").alias("h"), F.min("chars").alias("chars")
    )
    p = F.lit(s.prime)
    hash_ = F.pmod(F.pmod(F.shiftrightunsigned("h", 1), p) * 2 + F.col("h").bitwiseAND(1), p)  # h is unsigned to numpy
    before = [_mod((r - hash_) * F.lit(s.inverse(k)), s) for k, r in enumerate(_residues(F.col("fp")))]
    marks = F.array_join(F.filter(F.split("marks", ","), lambda d: d.try_cast("long") < F.col("depth")), ",")
    return n.select("*", (F.col("depth") - 1).alias("up_depth"), _packed(before).alias("up_fp"), marks.alias("up_marks"))


def _differing(turns: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(conv_id, depth) of sources whose text is another than their group's representative's; None if none is.

    Equal texts of a group are brought together before they are shuffled, so a first turn that a
    third of all conversations share is compared once for each task.
    """
    wanted = members.where("own").join(nodes.where("n_own > 1").select(*KEY), list(KEY)).select(*KEY, "conv_id", "t", "h", "g")
    said = _identified(turns).groupBy("conv_id", "t", "h", "g").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    texts = wanted.join(said, ["conv_id", "t", "h", "g"])
    each = texts.groupBy(*KEY, "role", "text").agg(F.min("conv_id").alias("least"))
    split = cut(each.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if split.isEmpty():
        return None
    w = Window.partitionBy(*KEY).orderBy("least", "role", "text")  # a row for each text that collides
    others = each.join(split, list(KEY)).withColumn("nth", F.row_number().over(w)).where("nth > 1")
    return texts.join(others, [*KEY, "role", "text"]).groupBy("conv_id").agg(F.min("depth").alias("depth"))


def _subtrees(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of each node's subtree.

    A node counts once, for its smallest conversation, which is in all nodes above it too. Each
    conversation sums what it counts for from its end, in blocks, and a node sums over its members.
    """
    leaf = (F.col("n_convs") == F.col("n_ends")).cast("long")
    worth = nodes.select(*KEY, F.col("conv_id").alias("least"), leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    mine = F.col("conv_id") == F.col("least")
    m = members.select("conv_id", *KEY, F.floor(F.col("depth") / BLOCK).alias("block")).join(worth, list(KEY))
    m = m.select("conv_id", *KEY, "block", *[F.when(mine, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")])
    later = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = m.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    after = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("leaf", "saved")])
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    m = m.join(after, ["conv_id", "block"])
    m = m.select(*KEY, *[(F.sum(c).over(inside) + F.col(f"{c}_after")).alias(c) for c in ("leaf", "saved")])
    return m.groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids, in order, of each node's conversations that end there.

    Ids are sorted by range over all nodes and joined to blocks, so that what one task hashes, in
    order and without holding it, is a few blocks even for a node where most conversations end.
    """
    kinds = "depth long, fp long, marks string"
    ends = members.where("ends").select(*KEY, "conv_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in KEY), strict=True))
            ids = b.column("conv_id").to_numpy()
            at = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            if at:
                cuts = list(zip(at, [*at[1:], len(keys)], strict=True))
                lists = [",".join(map(str, ids[a:z].tolist())) for a, z in cuts]
                yield pa.RecordBatch.from_arrays([*(pa.array([keys[a][k] for a, _ in cuts]) for k in range(3)), pa.array(ids[at]), pa.array(lists)], names=[*KEY, "least", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))), pa.array([d for _, d in rows], pa.string())], names=[*KEY, "ends_sha256"])

        now, digest = None, None
        for b in batches:
            rows = []
            for *key, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key != now:
                    if now is not None:
                        rows.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield out(rows)
        if now is not None:
            yield out([(now, digest.hexdigest())])

    joined = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(blocks, f"{kinds}, least long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def prefix_trie(turns: DataFrame, forks: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """A row for each node of the trie of turns(conv_id, turn, role, text).

    forks(conv_id, base, taken): conv_id takes the first turns of base, so many, for as many of its own.
    """
    s, spark = settings, small_batches(turns.sparkSession)
    folder = shared_folder(spark)
    rows = fingerprints(turns, s)
    plans = written(_plans(rows, forks, s), f"{folder}/plans")
    plain, failed = _members(rows, plans, s), []
    while True:
        members = written(_marked(plain, plans, failed), f"{folder}/members{len(failed)}")
        nodes = written(_nodes(members, s), f"{folder}/nodes{len(failed)}")
        found = _differing(turns, members, nodes)
        if found is None:
            break
        failed.append(cut(found))
    n = nodes.select(*KEY, "conv_id", "n_convs", "up_depth", "up_fp", "up_marks")
    ups = [F.col(f"up_{k}").alias(k) for k in KEY]
    children = nodes.where("depth > 0").groupBy(*ups).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(*[F.col(k).alias(f"up_{k}") for k in KEY], F.col("conv_id").alias("parent_conv_id"))
    n = n.join(children, list(KEY), "left").join(_subtrees(members, nodes), list(KEY)).join(_digests(members), list(KEY), "left")
    n = n.join(parents, [f"up_{k}" for k in KEY], "left")
    return n.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def rebuilt(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The forks that the contract names: the first crc32(c) % 6 turns of conversation c - c % 100."""
    c = F.col("conv_id").cast("long")
    ids = turns.where(c.isNotNull()).select(c.alias("conv_id")).distinct()
    return ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("taken"))


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(turns, rebuilt(spark, turns))


SQL = """
    with crc as (
      select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t
    ), ids as (
      select conv_id, conv_id - conv_id % 100 as base,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 6 as h
      from (select distinct conv_id from conversations where conv_id is not null), crc
    ), o as (
      select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, role nulls first, text nulls first) as turns from conversations where conv_id is not null group by 1
    ), r as (
      select i.conv_id, case when i.base = i.conv_id then c.turns else list_concat(coalesce(b.turns[:i.h], []), c.turns[i.h + 1:]) end as turns
      from ids i join o c on c.conv_id = i.conv_id left join o b on b.conv_id = i.base
    ), m as (
      select conv_id, d, turns[:d] as path, turns[:d - 1] as above, len(turns) = d as ends, coalesce(length(turns[d].t), 0) as chars from (select *, unnest(range(0, len(turns) + 1)) as d from r)
    ), n as (
      select d, path, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, bool_and(ends) as leaf, (count(*) - 1) * any_value(chars) as saved, sha256(coalesce(string_agg(case when ends then cast(conv_id as varchar) end, ',' order by conv_id), '')) as ends_sha256 from m group by 1, 2
    ), k as (
      select d - 1 as d, above as path, count(*) as n_children from n where d > 0 group by 1, 2
    ), s as (
      select m.d, m.path, sum(case when n.leaf then 1 else 0 end) as n_leaves, sum(n.saved) as saved_tokens from n join r on r.conv_id = n.conv_id join m on m.conv_id = n.conv_id and m.d <= n.d group by 1, 2
    )
    select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, cast(coalesce(k.n_children, 0) as bigint) as n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, n.ends_sha256
    from n left join k on k.d = n.d and k.path = n.path join s on s.d = n.d and s.path = n.path left join n p on p.d = n.d - 1 and p.path = n.above and n.d > 0
"""
