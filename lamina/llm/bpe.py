"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Texts are split by the tokenizer's pattern.  The distinct pieces of a batch go to an in-memory DuckDB of the worker: token-position rows join
the merge table (left id, right id -> rank), each piece contracts its leftmost pair of least rank, and the query recurs until no pair is
left.  Its rounds over one piece cost the square of the length, so pieces of more than LONG bytes without any break go to a second recursive query.
That one keeps its rows by key, a round gives back only the rows that changed, and it contracts the pairs of least rank from left to right as long as
no contraction makes a pair that would come before the next: the same pairs in the same order.

Decoding joins ids with the vocabulary and concatenates bytes by an ordered aggregate, for every id: a piece that is a token as a whole, and
is that token as the usual libraries have it, gets its bytes from its id too.  Results by piece are kept in a cache of bounded size, for words come
back often; its size changes only the speed.

Null texts count as empty and give no ids.  The vocabulary, some 50,000 tokens of a file given by path, is read on the driver and broadcast: its
size does not depend on the data.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from dataclasses import dataclass, field

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lamina.llm import arrow_text as at
from lamina.llm.common import bounded, trimmed

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces that one query contracts at once; pieces that each of the cache's two generations holds; pieces kept from task to task.
CHUNK, GENERATION, KEPT = 40_000, 150_000, 60_000
#: The first query holds about half of a piece's squared length over its rounds: so many such units a query, and longer pieces by the second.
CHUNK_UNITS, LONG = 20_000_000, 1024

# One row for each piece and round; a pair's value packs its rank above its position, so the least is the leftmost of least rank.  A rank is the
# id of the merged token.
ENCODE = """
with recursive contracted(w, ids, live) as (
    select w, ids, true from bytes_of
    union all
    select c.w,
           case when b.best is null then c.ids
                else list_concat(list_append(c.ids[:(b.best & 1048575) - 1], (b.best >> 20)::int), c.ids[(b.best & 1048575) + 2:]) end,
           b.best is not null
    from contracted c
    left join (
        select w, min((m.rank::bigint << 20) | pos) as best
        from (select w, unnest(ids[:-2]) as l, unnest(ids[2:]) as r, generate_subscripts(ids[2:], 1) as pos from contracted where live) p
        join merges m on m.pair = p.l::bigint * 1048576 + p.r
        group by w
    ) b on b.w = c.w
    where c.live
), done as (select w, ids from contracted where not live),
decoded as (
    select t.w, array_to_string(list(v.hex order by t.pos), '') as hex
    from (select w, unnest(ids) as id, generate_subscripts(ids, 1) as pos from done) t join vocabulary v on v.id = t.id
    group by t.w
)
select d.w, array_to_string(d.ids, ',') as ids, unhex(c.hex) as bytes from done d join decoded c on c.w = d.w
"""
# One row for each token, by piece and position, with the rank of its pair with the next.  Of a run of overlapping pairs every other one is taken; a
# turn is the last of its round if the pairs that it makes, to its left or its right, have no higher rank than its own.
ENCODE_LONG = """
with recursive tokens(w, pos, id, rank, live) using key (w, pos) as (
    select b.w, b.pos, b.id, m.rank, true
    from (select *, lead(id) over (partition by w order by pos) as next_id from bytes_of) b
    left join merges m on m.pair = b.id::bigint * 1048576 + b.next_id
    union
    (with here as (
        select w, pos, id, rank, lag(id) over o as left_id, lag(pos) over o as left_pos, lead(pos) over o as right_pos, lead(id, 2) over o as after_id,
               row_number() over o as i
        from recurring.tokens where live window o as (partition by w order by pos)
    ), least_rank as (
        select w, min(rank) as rank from recurring.tokens where live group by w
    ), hits as (
        select h.*, i - row_number() over (partition by h.w order by pos) as run from here h join least_rank b on b.w = h.w and b.rank = h.rank
    ), turns as (
        select *, coalesce(lag(right_pos) over o = left_pos, false) as touching
        from (select *, row_number() over (partition by w, run order by pos) as nth from hits) where nth % 2 = 1
        window o as (partition by w order by pos)
    ), made as (
        select t.*, l.rank as left_rank, r.rank as right_rank, coalesce(least(l.rank, r.rank) <= t.rank, false) as stops
        from turns t
        left join merges l on l.pair = (case when t.touching then t.rank else t.left_id end)::bigint * 1048576 + t.rank
        left join merges r on r.pair = t.rank::bigint * 1048576 + t.after_id
    ), kept as (
        select *, coalesce(lead(touching) over (partition by w order by pos), false) as touched, lead(left_rank) over (partition by w order by pos) as touched_rank
        from (select *, sum(stops::int) over (partition by w order by pos rows between unbounded preceding and 1 preceding) as before from made)
        where coalesce(before, 0) = 0
    )
    select w, pos, rank, case when touched then touched_rank else right_rank end, true from kept
    union all
    select w, right_pos, null, null, false from kept
    union all
    select w, left_pos, left_id, left_rank, true from kept where not touching and left_pos is not null)
)
select w, list(id order by pos) as ids from tokens where live group by w order by w
"""
DECODE = "select w, unhex(array_to_string(list(v.hex order by t.pos), '')) as bytes from tokens_of t join vocabulary v on v.id = t.id group by w order by w"


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens by rank, from a rank file."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


@dataclass
class Codec:
    """One worker's DuckDB with the merge table and the vocabulary, and the cache of pieces."""

    tokens: list[bytes]
    generation: int = GENERATION
    #: By piece: (ids as text, decoded bytes); and those of the generation before.
    known: dict[str, tuple[str, bytes]] = field(default_factory=dict)
    old: dict[str, tuple[str, bytes]] = field(default_factory=dict)

    def __post_init__(self):
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        pairs = [(i, self.rank[t[:k]], self.rank[t[k:]]) for i, t in enumerate(self.tokens) for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        rank, left, right = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        merges = pa.table({"pair": left * 1048576 + right, "rank": rank.astype(np.int32)})  # noqa: F841  read by name
        words = pa.table({"id": pa.array(np.arange(len(self.tokens), dtype=np.int32)), "hex": [t.hex() for t in self.tokens]})
        self.con.register("_merges", merges)
        self.con.register("_vocabulary", words)
        self.con.execute("create table merges as from _merges")
        self.con.execute("create table vocabulary as from _vocabulary")
        self.bytes = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def _run(self, name: str, rows: pa.Table, query: str) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(query).to_arrow_table()
        finally:
            self.con.unregister(name)

    def contracted(self, pieces: list[bytes]) -> list[tuple[str, bytes]]:
        """Ids of each piece as text, and what they decode to, by the recursive query."""
        offsets = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        rows = pa.table({"w": np.arange(len(pieces), dtype=np.int32), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))})
        out = self._run("bytes_of", rows, ENCODE)
        found: list = [None] * len(pieces)
        for w, ids, raw in zip(out.column("w").to_pylist(), out.column("ids").to_pylist(), out.column("bytes").to_pylist(), strict=True):
            found[w] = (ids, raw)
        return found

    def decoded(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each sequence of ids, by the ordered aggregate."""
        lengths = np.array([len(x) for x in ids], np.int64)
        pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        rows = pa.table({"w": np.repeat(np.arange(len(ids), dtype=np.int32), lengths), "pos": pos, "id": np.fromiter((i for x in ids for i in x), np.int32, lengths.sum())})
        out = self._run("tokens_of", rows, DECODE)
        by_w = dict(zip(out.column("w").to_pylist(), out.column("bytes").to_pylist(), strict=True))
        return [by_w.get(w, b"") for w in range(len(ids))]

    def contracted_long(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece by the second query."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        rows = pa.table({"w": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "id": ids})
        return self._run("bytes_of", rows, ENCODE_LONG).column("ids").to_pylist()

    def learned(self, pieces: list[str]) -> None:
        """Adds pieces to the cache: (ids as text, decoded bytes)."""
        whole: list[tuple[str, int]] = []
        part: list[str] = []
        raws: list[bytes] = []
        units = 0
        for p in pieces:
            raw = p.encode()
            if (r := self.rank.get(raw)) is not None:
                whole.append((p, r))
            elif len(raw) > LONG:
                (ids,) = self.contracted_long([raw])
                self.known[p] = (",".join(map(str, ids)), self.decoded([ids])[0])
            else:
                part.append(p)
                raws.append(raw)
                units += len(raw) ** 2
                if len(part) == CHUNK or units > CHUNK_UNITS:
                    self._learned(part, raws)
                    part, raws, units = [], [], 0
        if part:
            self._learned(part, raws)
        if whole:
            for (p, r), raw in zip(whole, self.decoded([[r] for _, r in whole]), strict=True):
                self.known[p] = (str(r), raw)

    def _learned(self, part: list[str], raws: list[bytes]) -> None:
        for p, found in zip(part, self.contracted(raws), strict=True):
            self.known[p] = found

    def know(self, pieces: set[str]) -> None:
        """Makes ``known`` hold all of the pieces, from the cache or by the queries."""
        if len(self.known) > self.generation:
            self.old, self.known = self.known, {}
        missing = []
        for p in pieces.difference(self.known):
            if (v := self.old.get(p)) is not None:
                self.known[p] = v
            else:
                missing.append(p)
        self.learned(missing)

    def rest(self) -> None:
        """Between tasks only the pieces seen first stay, among them the frequent ones, for other operators need a worker's memory too."""
        self.known, self.old = dict(itertools.islice(self.known.items(), KEPT)), {}


_CODECS: dict[bytes, Codec] = {}


def codec(tokens: list[bytes], generation: int = GENERATION) -> Codec:
    """The worker's codec for a vocabulary; a worker keeps the last one."""
    key = hashlib.sha256(b"\0".join(tokens)).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens)
    _CODECS[key].generation = generation
    return _CODECS[key]


def released() -> None:
    """Frees the worker's codec."""
    while _CODECS:
        _CODECS.popitem()[1].con.close()


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)])
#: Characters of texts whose pieces are held at once.
SPAN = 4_000_000
#: The cache's generations and the span where workers are to stay small.
LEAN_GENERATION, LEAN_SPAN = 60_000, 1_500_000


def encoded(docs: DataFrame, tokens: list[bytes] | None = None, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", with_ids: bool = True, lean: bool = False) -> DataFrame:
    """docs without the text but with n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids themselves as array<int>.

    Columns of docs with these names give way to the new ones.  lean: a small cache, and nothing kept in a worker between tasks, for plans in
    which other operators use the same workers; results are the same."""
    spark: SparkSession = bounded(docs.sparkSession)
    shared = spark.sparkContext.broadcast(tokens or vocabulary())
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] if with_ids else []
    new = {text_col.lower(), *(f.name for f in (*DIGESTS.fields, *ids_field))}
    rest = [f for f in docs.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*rest, *DIGESTS.fields, *ids_field])

    def run(batches):
        own, find = codec(shared.value, LEAN_GENERATION if lean else GENERATION), regex.compile(pattern).findall
        span = LEAN_SPAN if lean else SPAN
        for batch in batches:
            texts = at.column(batch, text_col)
            sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
            at_ = 0
            while at_ < len(texts):
                stop = max(at_ + 1, int(np.searchsorted(sizes, (sizes[at_ - 1] if at_ else 0) + span)))
                yield _encoded(batch.slice(at_, stop - at_), texts.slice(at_, stop - at_), own, find, [f.name for f in rest], with_ids, schema.names)
                at_ = stop
        own.rest()
        if lean:
            del own
            released()
        trimmed()

    return docs.mapInArrow(run, schema)


def _encoded(batch: pa.RecordBatch, texts: pa.Array, own: Codec, find, rest: list[str], with_ids: bool, names: list[str]) -> pa.RecordBatch:
    pieces = [find(t) for t in texts.to_pylist()]
    own.know(set().union(*pieces))
    known = own.known.__getitem__
    n, ids_sha, decoded_sha, packed = [], [], [], []
    for of in pieces:
        found = list(map(known, of))
        text = ",".join([f[0] for f in found])
        n.append(text.count(",") + 1 if text else 0)
        ids_sha.append(hashlib.sha256(text.encode()).hexdigest())
        decoded_sha.append(hashlib.sha256(b"".join([f[1] for f in found])).hexdigest())
        if with_ids:
            packed.append(np.array(text.split(","), np.int32) if text else np.zeros(0, np.int32))
    columns = [*(batch.column(c) for c in rest), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
    if with_ids:
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *packed]))))
    return pa.RecordBatch.from_arrays(columns, names=names)


def decoded(df: DataFrame, tokens: list[bytes] | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with the text of its ids as its last column; ids null: empty.  Bytes that are no UTF-8 become replacement characters.

    A column of df with the new one's name, whatever the case, gives way to it."""
    df = df.select(*(f"`{c}`" for c in df.columns if c.lower() != text_col.lower()))
    spark: SparkSession = bounded(df.sparkSession)
    shared = spark.sparkContext.broadcast(tokens or vocabulary())

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            out = own.decoded([x or [] for x in batch.column(ids_col).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.decode("utf-8", "replace") for b in out], pa.string())], names=[*batch.schema.names, text_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType(), False)]))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of documents."""
    return encoded(documents.select("doc_id", "text"), with_ids=False)
