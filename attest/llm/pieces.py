"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units that no piece of the vocabulary crosses (a blank or class of letters
begins a new one). For each distinct unit, all substrings up to the longest piece are exploded and
equi-joined to the piece table; the matches are the edges of the unit's lattice, which are grouped
by unit, and a higher-order aggregate folds them by Viterbi to the best sum of scores (of equal
sums, the longer last piece). Characters without a piece become their UTF-8 bytes' pieces.

The result is what SentencePiece's unigram mode gives for these pieces and scores, summed in
double precision (the library adds in single precision over the whole text, which blurs the sums
after a piece of score -1e9, such as a lone blank of some models). A model trained
by merges (BPE) has merge ranks as scores; its own encoder applies merges in rank order, which is
no best path, so its ids differ from these for some words, though both decode to the same text.

Each distinct unit goes through the lattice once, and its ids back to the parts of the input that hold
it, under a 64-bit hash of the unit: a part is a range of a file's rows (other tables are written
first), so the texts themselves are never shuffled. The piece table is of fixed size and is broadcast.

Defined cases: null and empty texts have no ids; very long texts are cut into units like others; a
text with the blank's own sign (U+2581) decodes to a blank there, as in the library; repeated rows
are encoded alike; an empty table gives an empty one; encode() carries all other columns and
replaces one named ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm.quality import bound
from attest.llm.shared import delivered, grouped, mapped, mixed, part_lists, parts_of, places, ranges, shared_folder, spans

BLANK = "▁"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
#: Units by classes of letters, and the coarser units where some piece crosses a class.
FINE = f"{BLANK}*[{_LETTERS}]+|{BLANK}*[^{_LETTERS}{BLANK}]+|{BLANK}+"
COARSE = f"{BLANK}*[^{BLANK}]+|{BLANK}+"
#: The library's penalty for a character without a piece, below the least score.
PENALTY = 10.0
#: Longer pieces are few; they are looked for only where their first characters stand.
SHORT = 4
#: Units of more characters are decoded by following back pointers.
LONG = 256
#: Rows of a file that share what comes back: more rows, fewer units that go to several parts, but slower to put together.
PART_ROWS = 8192
#: Characters that are cut into units at a time, units that are sent at a time, and units of a part whose hashes are remembered; beyond, it starts anew.
_RUN, _SENT, _MOST_KNOWN = 400_000, 50_000, 4_000_000
#: A random number for each character, and for each place in a unit.
_OF_CHAR = mixed(np.arange(0x110000, dtype=np.uint64) + np.uint64(0xC0FFEE))
_OF_PLACE = mixed(np.arange(1024, dtype=np.uint64) + np.uint64(0xFACADE))


def _needed(pieces: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
    """The pieces that some best path can use: those that no path of other pieces beats.

    A piece that loses to a path over its own characters loses wherever it stands, so leaving it
    out changes no result and makes the lattices smaller.
    """
    scores = {p: x for p, _, x in pieces}
    out = []
    for p, i, x in pieces:
        best = [0.0] + [float("-inf")] * len(p)
        for z in range(1, len(p) + 1):
            for a in range(z):
                if z - a < len(p) and p[a:z] in scores:
                    best[z] = max(best[z], best[a] + scores[p[a:z]])
        if len(p) == 1 or x >= best[-1]:
            out.append((p, i, x))
    return out


@dataclass(frozen=True)
class Vocabulary:
    """pieces: (piece, id, score) of the lattice; spelled: the bytes of each id, as decoding has them."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    spelled: tuple[bytes, ...]
    units: str

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, spelled = [], [0] * 256, []
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                spelled.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                spelled.append(b"")
            else:
                spelled.append(p.replace(BLANK, " ").encode())
                pieces.append((p, i, m.get_score(i)))
        fine = re.compile(FINE)
        units = FINE if all(fine.fullmatch(p) for p, _, _ in pieces) else COARSE
        return cls(tuple(_needed(pieces)), tuple(byte_ids), tuple(spelled), units)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame(self.pieces, columns=["piece", "id", "score"]), "piece string, id int, score double")


def kinds_of(units: str) -> np.ndarray:
    """Of each character: 0 for the blank, else a number for its class, if units end with one."""
    kinds = np.ones(0x110000, np.uint8)
    if units == FINE:
        kinds[:] = 2
        for a, z in re.findall("(.)-(.)", _LETTERS):
            kinds[ord(a) : ord(z) + 1] = 1
    kinds[ord(BLANK)] = 0
    return kinds


def _segments(text: str) -> Iterator[str]:
    """The text with its blanks' signs, cut before words where it is longer than what is handled at a time."""
    text = BLANK + text.replace(" ", BLANK)
    while len(text) > _RUN:
        z = text.rfind(BLANK, 1, _RUN)
        while z > 0 and text[z - 1] == BLANK:
            z -= 1
        if z <= 0:  # a word of that length stays whole
            break
        yield text[:z]
        text = text[z:]
    yield text


@dataclass
class _Run:
    """Some texts' units: where each starts, its length and hash; of: the text that each segment is of; ends: the units up to each segment's end."""

    of: list[int]
    ends: np.ndarray
    chars: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray

    @classmethod
    def cut(cls, of: list[int], held: list[str], kinds: np.ndarray) -> "_Run":
        chars = np.frombuffer("".join(held).encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(x) for x in held])
        kind, first = kinds[chars], np.ones(len(chars), bool)
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first[1:] &= kind[:-1] != 0  # blanks are at the front of a unit
        first[ends[:-1]] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(starts, append=len(chars))
        place = np.arange(len(chars)) - np.repeat(starts, sizes)
        longest = int(sizes.max())
        of_place = _OF_PLACE if longest <= len(_OF_PLACE) else mixed(np.arange(longest, dtype=np.uint64) + np.uint64(0xFACADE))
        hashes = mixed(np.add.reduceat(_OF_CHAR[chars] * of_place[place], starts))
        return cls(of, np.searchsorted(starts, ends), chars, starts, sizes, hashes)

    def spelled(self, which: np.ndarray) -> list[str]:
        n = self.sizes[which]
        ends = np.cumsum(n)
        text = self.chars[ranges(self.starts[which], n)].tobytes().decode("utf-32-le")
        return [text[a:z] for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True)]


def _runs(texts: list[str | None], kinds: np.ndarray) -> Iterator[_Run]:
    of, held, size = [], [], 0
    for i, t in enumerate(texts):
        for x in _segments(t) if t else ():
            if held and size + len(x) > _RUN:
                yield _Run.cut(of, held, kinds)
                of, held, size = [], [], 0
            of.append(i)
            held.append(x)
            size += len(x)
    if held:
        yield _Run.cut(of, held, kinds)


def gathered(frames: Iterator[pd.DataFrame], units: str) -> Iterator[pd.DataFrame]:
    """(part, unit): the distinct units of each part's texts (__part, t), by their hashes."""
    kinds, part, known, held = kinds_of(units), None, np.zeros(0, np.uint64), []

    def sent() -> Iterator[pd.DataFrame]:
        for i in range(0, len(held), _SENT):
            some = held[i : i + _SENT]
            yield pd.DataFrame({"part": np.full(len(some), part, np.int64), "unit": pd.Series(some, dtype=object)})
        held.clear()

    for frame in frames:
        parts, texts = frame["__part"].to_numpy(), frame["t"].tolist()
        for a, z in spans(parts):
            if (p := int(parts[a])) != part:
                yield from sent()
                part, known = p, np.zeros(0, np.uint64)
            for run in _runs(texts[a:z], kinds):
                one, _ = grouped(run.hashes)
                new = one[places(known, run.hashes[one]) < 0]
                held += run.spelled(new)
                known = np.zeros(0, np.uint64) if len(known) > _MOST_KNOWN else known
                known = np.insert(known, np.searchsorted(known, run.hashes[new]), run.hashes[new])
                if len(held) > _SENT:
                    yield from sent()
    yield from sent()


def lattice(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, ids) of units(unit), which are distinct: ids is the best path's."""
    table = F.broadcast(vocabulary.table(units.sparkSession))
    longest = max((len(p) for p, _, _ in vocabulary.pieces), default=1)
    unknown = min((s for _, _, s in vocabulary.pieces), default=0.0) - PENALTY
    begins = [p[:SHORT] for p, _, _ in vocabulary.pieces if len(p) > SHORT]
    reach = F.when(F.substring(F.col("unit"), F.col("start"), F.lit(SHORT)).isin(sorted(set(begins))), longest).otherwise(SHORT) if begins else F.lit(longest)
    starts = units.select("unit", F.explode(F.sequence(F.lit(1), F.char_length("unit"))).alias("start"))
    spans = starts.select("unit", "start", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + reach - 1, F.char_length("unit")))).alias("end"))
    spelled = spans.withColumn("piece", F.substring(F.col("unit"), F.col("start"), F.col("end") - F.col("start") + 1))
    edges = spelled.join(table, "piece", "left").where(F.col("id").isNotNull() | (F.col("start") == F.col("end")))
    edge = F.struct("end", "start", F.coalesce("score", F.lit(unknown)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    grouped = edges.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    edges_, short = F.col("edges"), F.char_length("unit") <= LONG
    path = F.when(short, _path(edges_, True)).otherwise(_path(edges_, False))
    return grouped.select("unit", bound(path, lambda p: _ids(p, vocabulary)).alias("ids"))


def _path(edges: Column, whole: bool) -> Column:
    """The best path's ids in order, from edges sorted by end and start; unknown ones are -start.

    The fold's state is the best edge into each place so far; an edge to a new place is appended,
    a better one to the last place takes its turn. whole: each place holds the ids of its path,
    which suits short units; else the path is followed back once from the end.
    """
    node = "struct<score:double,start:int,ids:array<int>>"
    none = F.array().cast("array<int>")

    def step(done: Column, e: Column) -> Column:
        first = e["start"] <= 1
        before = F.get(done, e["start"] - 2)
        score = e["score"] + F.when(first, 0.0).otherwise(before["score"])
        own = F.array(F.when(e["id"] < 0, -e["start"]).otherwise(e["id"]))
        ids = F.when(first, own).otherwise(F.concat(before["ids"], own)) if whole else own
        new = F.array(F.struct(score.alias("score"), e["start"].alias("start"), ids.alias("ids")))
        return F.when(F.size(done) < e["end"], F.concat(done, new)).when(score > F.get(done, e["end"] - 1)["score"], F.concat(F.slice(done, F.lit(1), e["end"] - 1), new)).otherwise(done)

    def back(nodes: Column) -> Column:
        begin = F.struct(F.size(nodes).alias("at"), none.alias("path"))

        def walk(t: Column, _: Column) -> Column:
            n = F.get(nodes, t["at"] - 1)
            return F.when(t["at"] > 0, F.struct((n["start"] - 1).alias("at"), F.concat(n["ids"], t["path"]).alias("path"))).otherwise(t)

        return F.aggregate(F.sequence(F.lit(1), F.size(nodes)), begin, walk, lambda t: t["path"])

    nodes = F.aggregate(edges, F.array().cast(f"array<{node}>"), step)
    return F.element_at(nodes, -1)["ids"] if whole else bound(nodes, back)


def _ids(path: Column, vocabulary: Vocabulary) -> Column:
    """The ids of a path; a character without a piece (minus its place) becomes its bytes' pieces."""
    table = F.array(*[F.lit(i) for i in vocabulary.byte_ids])

    def spelled(place: Column) -> Column:
        code = F.hex(F.encode(F.substring(F.col("unit"), place, F.lit(1)), "UTF-8"))
        places = F.sequence(F.lit(1), F.length(code) - 1, F.lit(2))
        return F.transform(places, lambda i: F.get(table, F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int")))

    return F.when(F.array_min(path) < 0, F.flatten(F.transform(path, lambda p: F.when(p >= 0, F.array(p)).otherwise(spelled(-p))))).otherwise(path)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", finish=None, schema: str = "ids array<int>", carried: list[str] | None = None) -> DataFrame:
    """docs with ids. finish(texts, arrays of ids, spelling) may give other columns, of the named schema.

    carried: the columns of docs that come back (all by default).
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    parted = parts_of(docs, PART_ROWS)
    cutter = vocabulary.units

    # a part that two tasks read sends some twice
    dealt = mapped(parted.select("__part", F.col(text).alias("t")), lambda frames: gathered(frames, cutter), "part long, unit string").repartition("unit").distinct()
    # both sides below read all columns of one exchange, which is then made once
    apart = dealt.groupBy("unit").agg(F.min("part").alias("any")).where("any is not null").select("unit")
    short = "array<smallint>" if max([*vocabulary.byte_ids, *(i for _, i, _ in vocabulary.pieces)]) < 1 << 15 else "array<int>"
    best = lattice(apart, vocabulary).withColumn("ids", F.col("ids").cast(short))
    delivered(dealt.join(best.hint("shuffle_hash"), "unit").select("part", F.xxhash64("unit").alias("unit"), "ids"), f"{folder}/units")

    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    kept = [c for c in (docs.columns if carried is None else carried) if c not in names]
    held = spark.sparkContext.broadcast((vocabulary.spelled, cutter, folder))

    def assemble(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spelled, units, where = held.value
        spelling, kinds, part, table = Spelling(spelled), kinds_of(units), None, None
        for frame in (f.iloc[i : i + 500] for f in frames for i in range(0, len(f), 500)):
            for a, z in spans(frame["__part"].to_numpy()):
                some = frame.iloc[a:z].reset_index(drop=True)
                if (p := int(some["__part"].iat[0])) != part:
                    table = None
                    part, table = p, _Units(f"{where}/units", p)
                texts = some[text].tolist()
                arrays = table.of_texts(texts, kinds)
                made = finish(texts, arrays, spelling) if finish else pd.DataFrame({"ids": arrays})
                yield pd.concat([some[kept], made], axis=1)

    columns = "".join(f"`{x.name}` {x.dataType.simpleString()}, " for x in docs.schema if x.name in kept)
    return mapped(parted, assemble, f"{columns}{schema}").select(*kept, *names)


class _Units:
    """The units of one part of the input by their hashes, and their ids.

    Units that were met are known by the hash that cutting gives them; at: their places in the table.
    """

    def __init__(self, folder: str, part: int) -> None:
        unit, self.ids, ends = part_lists(folder, part, "unit", "ids")
        self.order = np.argsort(unit)
        self.unit, self.starts, self.sizes = unit[self.order], ends[:-1], np.diff(ends)
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of_texts(self, texts: list[str | None], kinds: np.ndarray) -> list[np.ndarray]:
        """The ids of each text as 32-bit numbers."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for run in _runs(texts, kinds):
            at = self._of_run(run)
            flat = self.ids[ranges(self.starts[at], self.sizes[at])].astype(np.int32)
            ends = np.append(0, np.cumsum(self.sizes[at]))[run.ends]
            for i, x in zip(run.of, np.split(flat, ends[:-1]), strict=True):
                out[i].append(x)
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in out]

    def _of_run(self, run: _Run) -> np.ndarray:
        """The place of each unit's ids in the table."""
        one, inverse = grouped(run.hashes)
        hashes = run.hashes[one]
        if len(self.known) > _MOST_KNOWN:
            self.known, self.at = self.known[:0], self.at[:0]
        new = np.flatnonzero(places(self.known, hashes) < 0)
        units = run.spelled(one[new])
        at = places(self.unit, np.fromiter((xxhash.xxh64_intdigest(u.encode("utf-8", "replace"), 42) for u in units), np.uint64, len(units)).view(np.int64))
        if (at < 0).any():
            raise ValueError("a unit has no ids: the texts are not those that were counted")
        where = np.searchsorted(self.known, hashes[new])
        self.known, self.at = np.insert(self.known, where, hashes[new]), np.insert(self.at, where, self.order[at])
        return self.at[np.searchsorted(self.known, hashes)][inverse]


class Spelling:
    """The bytes of all ids in one array."""

    def __init__(self, spelled: tuple[bytes, ...]) -> None:
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, ids: np.ndarray) -> bytes:
        return b"".join([self.data[ranges(self.starts[x], self.sizes[x])].tobytes() for x in (ids[i : i + _RUN] for i in range(0, len(ids), _RUN))])


def decoded(ids: np.ndarray, spelling: Spelling) -> str:
    """The text of ids; the blank that encoding puts first is taken off again."""
    return spelling.of(ids).decode("utf-8", "replace").removeprefix(" ")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the text of its ids; null ids give null."""
    kept = [c for c in encoded.columns if c != text]
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary.spelled)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spelling = Spelling(held.value)
        for frame in frames:
            yield frame[kept].assign(**{text: [None if x is None else decoded(np.asarray(x, np.int64), spelling) for x in frame[ids]]})

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in encoded.select(*kept).schema)
    return mapped(encoded.select(*kept), run, f"{kinds}, `{text}` string")


def _digest(texts: list, arrays: list[np.ndarray], spelling: Spelling) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "n_pieces": [len(a) for a in arrays],
            "ids_crc32": [zlib.crc32(a.astype("<u4").tobytes()) for a in arrays],
            "round_trip": [decoded(a, spelling) == (t or "").replace(BLANK, " ") for t, a in zip(texts, arrays, strict=True)],
        }
    )


def encoded_digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids) and round_trip (decoding gives the text)."""
    return encode(docs.select("doc_id", "text"), vocabulary, finish=_digest, schema="n_pieces long, ids_crc32 long, round_trip boolean", carried=["doc_id"])


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.of(public_tokenizers.path("piece_bpe_32k.model")))
