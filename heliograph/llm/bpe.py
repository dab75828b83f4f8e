"""Operator 9: byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A task cuts its texts into the tokenizer's pieces and hands them to an in-process DuckDB.  A recursive query starts from one
row per byte of every distinct piece (piece, position, token and next token), joins them with the merge table, and contracts in each
piece the leftmost pair of minimum rank, until no pair of any piece is in the table.  Pieces of more than LONG bytes go through a
recursive query that contracts, in one step, all occurrences of that pair that the first one would contract one after another.
Decoding joins token rows with the tokens' bytes and aggregates those in order of position.  A task remembers the tokens of the
pieces that it has met, in bounded memory; all that it holds goes with the task.
Documents stay where they are: there is no shuffle.  The rank file is read on the driver and broadcast (a vocabulary, whatever the data).
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.common import lean, light_batches, table
from heliograph.llm.textnum import chunks

#: Rank file of the tokenizer; a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces; letters come first, which changes nothing but the time.
PATTERN = r""" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of pieces that a task remembers, each counted with PIECE_BYTES more; beyond that it starts afresh. A matter of memory alone.
REMEMBERED_BYTES, PIECE_BYTES = 56 << 20, 170
#: Bytes of text that are encoded at once; a matter of memory alone.
AT_ONCE = 1 << 20
#: What a task's DuckDB may hold before it spills to Spark's own scratch folder.
DUCKDB_MEMORY = "160MB"

_TOKENS, _DECODED = T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())

_tables: dict[str, tuple[pa.Table, pa.Table]] = {}


def load_ranks(path: str) -> tuple[pa.Table, pa.Table]:
    """(tokens: t, bytes; merges: a, b, t, safe) of a rank file; a merge is safe if its token makes no pair of lower rank with any neighbour."""
    if path not in _tables:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        left, right, to = [], [], []
        for word, t in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(t)
        unsafe = {x for a, b, t in zip(left, right, to, strict=True) for x in (a, b) if t < x}
        tokens = pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        merges = pa.table({"a": pa.array(left, pa.int32()), "b": pa.array(right, pa.int32()), "t": pa.array(to, pa.int64()), "safe": pa.array([t not in unsafe for t in to])})
        _tables[path] = tokens, merges
    return _tables[path]


#: Tokens of the pieces in `fresh` (w: piece, g, ng, byte, nbyte) of ordinary length.  State: a row for each token, g its place, t the token, ng and nt the next one's
#: (-1 and null: none).  Each step contracts the leftmost pair of minimum rank of each piece: its first row takes the merged token and the second row's next
#: one, the second row goes, and the row before learns of its new neighbour.  Pieces without such a pair leave as done.
_CONTRACT = """
WITH RECURSIVE step AS (
  SELECT f.w, f.g, f.ng, a.t, b.t AS nt, false AS done FROM fresh f JOIN byte_token a USING (byte) LEFT JOIN byte_token b ON b.byte = f.nbyte WHERE NOT long
  UNION ALL
  SELECT s.w, s.g, CASE WHEN s.g = c.g THEN c.nng ELSE s.ng END, CASE WHEN s.g = c.g THEN c.m ELSE s.t END,
         CASE WHEN s.g = c.g THEN c.nnt WHEN s.ng = c.g THEN c.m ELSE s.nt END, c.w IS NULL
  FROM step s LEFT JOIN (
    SELECT b.w, b.m, b.g, n.g AS gone, n.ng AS nng, n.nt AS nnt
    FROM step n JOIN (
      SELECT w, (best // {wide})::INT AS m, (best % {wide})::INT AS g, ng FROM (
        SELECT a.w, min(merges.t * {wide} + a.g) AS best, arg_min(a.ng, merges.t * {wide} + a.g) AS ng
        FROM step a JOIN merges ON merges.a = a.t AND merges.b = a.nt WHERE NOT a.done GROUP BY a.w)
    ) b ON n.g = b.ng WHERE NOT n.done
  ) c ON s.w = c.w
  WHERE NOT s.done AND s.g IS DISTINCT FROM c.gone
)
SELECT w, g, t FROM step WHERE done
"""
#: The same for long pieces.  All occurrences of a piece's leftmost pair of minimum rank are contracted at once, from the left, where none of the pairs that this makes
#: (with the tokens beside it, as they were and as they will be) has a lower rank: the leftmost one is then followed by the others anyway.  Else it alone is.
_CONTRACT_LONG = """
WITH RECURSIVE step AS (
  SELECT w, g, byte_token.t, false AS done FROM fresh JOIN byte_token USING (byte) WHERE long
  UNION ALL
  SELECT w, g, CASE WHEN taken THEN m ELSE t END::INT, NOT any_taken
  FROM (SELECT *, lag(taken, 1, false) OVER (PARTITION BY w ORDER BY g) AS gone, bool_or(taken) OVER (PARTITION BY w) AS any_taken FROM (
    SELECT w, g, t, m, coalesce(hit AND CASE WHEN risky THEN g = first_g ELSE row_number() OVER (PARTITION BY w, island, hit ORDER BY g) % 2 = 1 END, false) AS taken FROM (
      SELECT x.*, bool_or(hit AND NOT x.safe AND least(l.t, r.t, twice.t) < m) OVER (PARTITION BY w) AS risky, min(CASE WHEN hit THEN g END) OVER (PARTITION BY w) AS first_g FROM (
        SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY w ORDER BY g) AS island FROM (
          SELECT *, coalesce(m = min(m) OVER (PARTITION BY w), false) AS hit FROM (
            SELECT n.w, n.g, n.t, n.before, n.after, merges.t AS m, merges.safe
            FROM (SELECT w, g, t, lead(t) OVER o AS nt, lead(t, 2) OVER o AS after, lag(t) OVER o AS before FROM step WHERE NOT done WINDOW o AS (PARTITION BY w ORDER BY g)) n
            LEFT JOIN merges ON merges.a = n.t AND merges.b = n.nt))) x
      LEFT JOIN merges l ON NOT x.safe AND x.hit AND l.a = x.before AND l.b = x.m
      LEFT JOIN merges r ON NOT x.safe AND x.hit AND r.a = x.m AND r.b = x.after
      LEFT JOIN merges twice ON NOT x.safe AND x.hit AND twice.a = x.m AND twice.b = x.m)))
  WHERE NOT gone
)
SELECT w, g, t FROM step WHERE done
"""
#: Bytes from which a piece counts as long; a matter of speed alone.
LONG = 100
_WIDE = 1 << 36


class _Pieces(dict):
    """piece -> its number; a piece that is asked for the first time gets the next one and is noted as fresh."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class Codec:
    """Encoding and decoding in one DuckDB connection, with the pieces that it has met."""

    def __init__(self, ranks: tuple[pa.Table, pa.Table]):
        import duckdb
        import regex

        tokens, merges = ranks
        self.cut = regex.compile(PATTERN).findall
        self.db = duckdb.connect(config={"threads": 1})
        self.db.execute(f"SET memory_limit = '{DUCKDB_MEMORY}'")
        scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        if scratch:
            self.db.execute(f"SET temp_directory = '{os.path.join(scratch, f'heliograph-bpe-{os.getpid()}')}'")
        self.db.register("tokens_in", tokens)
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE tokens AS SELECT t, hex(bytes) AS h FROM tokens_in")
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.execute("CREATE TABLE byte_token AS SELECT t, ('0x' || h)::UTINYINT AS byte FROM tokens WHERE length(h) = 2")
        self.db.unregister("tokens_in")
        self.db.unregister("merges_in")
        self.contract = _CONTRACT.replace("{wide}", str(_WIDE))
        self.forget()

    def __enter__(self) -> Codec:
        return self

    def __exit__(self, *_) -> None:
        """Gives back what the codec holds: worker processes outlive their tasks."""
        self.db.close()
        self.forget()

    def forget(self) -> None:
        self.pieces, self.held = _Pieces(), 0
        #: Tokens of all pieces in order of their numbers, and where each piece's begin.
        self.tokens, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Contracts the pieces that aren't known yet."""
        fresh, self.pieces.fresh = self.pieces.fresh, []
        if not fresh:
            return
        raw = [x.encode() for x in fresh]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.held += int(sizes.sum()) + PIECE_BYTES * len(raw)
        begin = np.cumsum(sizes) - sizes
        g, byte = np.arange(sizes.sum(), dtype=np.int32), np.frombuffer(b"".join(raw), np.uint8)
        last = np.zeros(len(g), bool)
        last[begin + sizes - 1] = True
        rows = {"w": np.repeat(np.arange(len(raw), dtype=np.int32), sizes), "g": g, "ng": np.where(last, -1, g + 1).astype(np.int32), "byte": byte}
        rows |= {"nbyte": np.where(last, -1, np.append(byte[1:], 0)).astype(np.int16), "long": np.repeat(sizes > LONG, sizes)}
        self.db.register("fresh", pa.table(rows))
        parts = [self.contract] * bool((sizes <= LONG).any()) + [_CONTRACT_LONG] * bool((sizes > LONG).any())
        got = self.db.sql(" UNION ALL ".join(f"SELECT * FROM ({x})" for x in parts) + " ORDER BY g").to_arrow_table()
        self.db.unregister("fresh")
        self.tokens = np.concatenate([self.tokens, got["t"].to_numpy()])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.bincount(got["w"].to_numpy(), minlength=len(raw)))])

    def encode(self, texts: list[str | None]) -> pa.Array:
        """Token lists of texts; null for null."""
        if self.held > REMEMBERED_BYTES:
            self.forget()
        number, found = self.pieces.__getitem__, [np.zeros(0, np.int64)]
        for text in texts:
            cut = self.cut(text) if text else []
            found.append(np.fromiter(map(number, cut), np.int64, len(cut)))
        self.learn()
        pieces = np.concatenate(found)
        begin, size = self.start[pieces], self.start[pieces + 1] - self.start[pieces]
        edge = np.concatenate([[0], np.cumsum(size)])
        flat = self.tokens[np.arange(edge[-1]) + np.repeat(begin - edge[:-1], size)]
        offsets = edge[np.cumsum([len(x) for x in found])]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
        none = pa.array([x is None for x in texts])
        return pc.if_else(none, pa.scalar(None, lists.type), lists)

    def decode(self, lists: pa.Array) -> pa.Array:
        """Texts of token lists; null for null. Tokens that are not in the vocabulary are left out, broken UTF-8 is replaced."""
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        rows = pa.table({"doc": pa.array(np.repeat(np.arange(len(lists), dtype=np.int32), size)), "pos": pa.array(np.arange(len(flat), dtype=np.int32)), "t": flat})
        self.db.register("token_rows", rows)  # one thread aggregates rows in the order that they come in
        got = self.db.sql("SELECT doc, unhex(string_agg(h, '')) AS bytes FROM (SELECT doc, h FROM token_rows JOIN tokens USING (t) ORDER BY pos) GROUP BY doc").to_arrow_table()
        self.db.unregister("token_rows")
        texts = dict(zip(got["doc"].to_pylist(), got["bytes"].to_pylist(), strict=True))
        return pa.array([None if not ok else texts.get(i, b"").decode("utf-8", "replace") for i, ok in enumerate(lists.is_valid().to_pylist())], pa.string())


def _sent(docs: DataFrame, path: str):
    """The rank file's tables for the executors, and Arrow batches of bounded bytes for the session."""
    light_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(load_ranks(path))


def _runs(batch: pa.RecordBatch, column: int):
    for lo, hi, _, _ in chunks(batch.column(column), AT_ONCE):
        yield batch.slice(lo, hi - lo)


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """docs with a column tokens (array of int), replacing one of that name: the token ids of text.

    A null text has null tokens, an empty one an empty list; rows, their order within a partition, and all other columns stay.
    """
    docs, sent = docs.drop("tokens"), _sent(docs, path)
    at = docs.columns.index("text")

    def run(batches):
        with Codec(sent.value) as one:
            for batch in batches:
                for part in _runs(batch, at):
                    yield pa.RecordBatch.from_arrays([*part.columns, one.encode(part.column(at).to_pylist())], [*part.schema.names, "tokens"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema, _TOKENS]))


def decode(rows: DataFrame, path: str = RANKS, column: str = "tokens") -> DataFrame:
    """rows with a column decoded (string), replacing one of that name: the text of the token ids in `column`; null for null."""
    rows, sent = rows.drop("decoded"), _sent(rows, path)
    at = rows.columns.index(column)

    def run(batches):
        with Codec(sent.value) as one:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    yield pa.RecordBatch.from_arrays([*part.columns, one.decode(part.column(at))], [*part.schema.names, "decoded"])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema, _DECODED]))


def encode_decode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """encode() and decode() in one pass over the documents, so that token lists needn't leave the task in between."""
    docs, sent = docs.drop("tokens", "decoded"), _sent(docs, path)
    at = docs.columns.index("text")

    def run(batches):
        with Codec(sent.value) as one:
            for batch in batches:
                for part in _runs(batch, at):
                    tokens = one.encode(part.column(at).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns, tokens, one.decode(tokens)], [*part.schema.names, "tokens", "decoded"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema, _TOKENS, _DECODED]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.array_join(F.col("tokens").cast("array<string>"), " ")  # token ids as text, which all engines compare alike
    return encode_decode(docs).select("doc_id", text.alias("tokens"), F.size("tokens").alias("n_tokens"), "decoded")


_SPACE = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A character for private use that parts the last white space of a run from those before it: RE2 can't look ahead.
_PART = "\ue000"
#: (doc row r, doc_id, text, tokens) of documents, with the rank file read as a table.
TOKENS_SQL = f"""
WITH RECURSIVE ranks AS (SELECT hex(from_base64(line[1])) AS h, line[2]::INT AS t FROM (SELECT string_split(line, ' ') AS line FROM read_csv('{RANKS}', columns = {{'line': 'VARCHAR'}}, delim = '\x01', quote = '', escape = '', header = false))),
splits AS (SELECT t, substr(h, 1, 2 * i) AS a, substr(h, 2 * i + 1) AS b FROM (SELECT t, h, unnest(range(1, length(h) // 2)) AS i FROM ranks WHERE length(h) > 2)),
merges AS (SELECT l.t AS a, r.t AS b, s.t FROM splits s JOIN ranks l ON l.h = s.a JOIN ranks r ON r.h = s.b),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
cut AS (SELECT r, regexp_extract_all(regexp_replace(text, '([{_SPACE}]+)([{_SPACE}])([^{_SPACE}])', '\\1{_PART}\\2\\3', 'g'),
  '''s|''t|''re|''ve|''m|''ll|''d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_SPACE}\\p{{L}}\\p{{N}}{_PART}]+|[{_SPACE}]+') AS ps FROM docs),
pieces AS (SELECT r, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece FROM cut),
known AS (SELECT row_number() OVER () AS w, piece, hex(encode(piece)) AS h FROM (SELECT DISTINCT piece FROM pieces)),
start AS (SELECT w, p, ranks.t FROM (SELECT w, p, substr(h, 2 * p + 1, 2) AS h FROM (SELECT w, h, unnest(range(length(h) // 2)) AS p FROM known)) JOIN ranks USING (h)),
step AS (
  SELECT w, p, t, false AS done FROM start
  UNION ALL
  SELECT w, p, CASE WHEN p = best % 1048576 THEN best // 1048576 ELSE t END::INT, best IS NULL
  FROM (SELECT *, lag(p) OVER (PARTITION BY w ORDER BY p) = best % 1048576 AS gone FROM (
    SELECT x.w, x.p, x.t, min(merges.t::BIGINT * 1048576 + x.p) OVER (PARTITION BY x.w) AS best
    FROM (SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS nt FROM step WHERE NOT done) x LEFT JOIN merges ON merges.a = x.t AND merges.b = x.nt))
  WHERE gone IS NOT TRUE
),
of_piece AS (SELECT piece, list(t ORDER BY p) AS ts FROM step JOIN known USING (w) WHERE done GROUP BY piece),
of_doc AS (SELECT r, flatten(list(ts ORDER BY i)) AS tokens FROM pieces JOIN of_piece USING (piece) GROUP BY r),
encoded AS (SELECT docs.r, doc_id, text, CASE WHEN text IS NOT NULL THEN coalesce(tokens, []) END AS tokens FROM docs LEFT JOIN of_doc USING (r))
"""
ORACLE_SQL = (
    TOKENS_SQL
    + """
SELECT doc_id, array_to_string(tokens, ' ') AS tokens, len(tokens)::INT AS n_tokens, CASE WHEN text IS NOT NULL THEN coalesce(decode(unhex(bytes)), '') END AS decoded
FROM encoded LEFT JOIN (
  SELECT r, string_agg(h, '' ORDER BY i) AS bytes FROM (SELECT r, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS t FROM encoded) JOIN ranks USING (t) GROUP BY r) USING (r)
"""
)
