"""The engine's queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nn
from ..functions import tensors as X
from ..functions import text as T
from ..operators import analytics as A
from ..operators import bpe_codec as C
from ..operators import bpe_train as B
from ..operators import training as TR
from ..sources import artifacts
from ..sources.scratch import folder, goes_at_exit, written
from ..streaming import encode as S
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

SPECIAL = "<|endoftext|>"
#: Merges that Spark and SQL share without training; each side is a byte or made by an earlier merge.
MERGES = [tuple(x.encode() for x in m) for m in [(" ", "t"), ("h", "e"), ("i", "n"), ("e", "r"), (" t", "he"), ("o", "n"), ("r", "e"), (" ", "d"), ("e", "n"), ("a", "n"), ("i", "on"), ("in", "g"), (" d", "e"), ("t", "ion")]]
TRAIN_MERGES = 6
SHOWN = 6  # digits that computed numbers are rounded to


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def tokenizer(special: bool = False) -> C.Tokenizer:
    vocab = dict(enumerate([*(bytes([i]) for i in range(256)), *(a + b for a, b in MERGES)]))
    return C.Tokenizer(vocab, MERGES, [SPECIAL] if special else [])


JOINED = [a + b for a, b in MERGES]
ENCODED = f"SELECT doc_id, {O.encoded('text', MERGES)} AS h FROM documents"
VOCAB = O.vocabulary(JOINED)
LONG = f"SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, token_id FROM (SELECT doc_id, unnest(h) AS token_hex, generate_subscripts(h, 1) AS pos FROM ({ENCODED})) JOIN ({VOCAB}) USING (token_hex)"
SIZES = f"SELECT doc_id, lang, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_chars, CAST(len({O.encoded('text', MERGES)}) AS BIGINT) AS n_tokens FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.encode_long(table(spark, sf_dir), tokenizer())


def totals(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """(``by``, n_bytes, n_chars, n_tokens, ratio, chars_per_token) of all texts: from the histogram, each distinct pre-token encoded once."""
    docs = table(spark, sf_dir)
    counts = docs.select(*by, F.explode(T.pretokens(F.col("text"))).alias("pretoken")).groupBy(*by, "pretoken").agg(F.count("*").alias("n"))
    sums = C.sizes_of_types(written(counts), tokenizer(), *by)
    if by:  # groups of empty texts alone
        keys = docs.select(*by).distinct().withColumnsRenamed({c: f"_{c}" for c in by})
        same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by]
        sums = keys.join(sums, same, "left").drop(*by).withColumnsRenamed({f"_{c}": c for c in by})
    n = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_bytes", "n_chars", "n_tokens")}
    sums = sums.select(*by, *n.values())
    return sums.withColumn("ratio", T.ratio(F.col("n_bytes"), F.col("n_tokens"))).withColumn("chars_per_token", T.ratio(F.col("n_chars"), F.col("n_tokens")))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, characters and tokens of each document, without spreading the tokens out."""
    done = C.encode_arrays(table(spark, sf_dir).select("doc_id", "lang", "text"), tokenizer(), form="chain")
    out = done.select("doc_id", "lang", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"), F.size("tokens").cast("long").alias("n_tokens"))
    return out.withColumn("ratio", T.ratio(F.col("n_bytes"), F.col("n_tokens")))


# --- pre-tokens and training ---------------------------------------------------------------


@query(O.counts())
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.histogram(table(spark, sf_dir))


@query(f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_pretokens, CAST(len(list_distinct(p)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {O.pretokens('text')} AS p FROM documents)")
def pretokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir).select("doc_id", T.pretokens(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_pretokens"), F.size(F.array_distinct("p")).cast("long").alias("n_distinct"))


@query("SELECT byte_hex, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(pretoken)), '..')) AS byte_hex, n FROM (" + O.counts() + ")) GROUP BY byte_hex")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over distinct pre-tokens with their counts, not over the text."""
    types = B.hex_types(B.histogram(table(spark, sf_dir)))
    return types.select(F.explode(T.token_list(F.col("tokens"))).alias("byte_hex"), "n").groupBy("byte_hex").agg(F.sum("n").alias("n"))


def _sql_pairs(types: str) -> str:
    return f"SELECT t[i] AS left_hex, t[i + 1] AS right_hex, CAST(sum(n) AS BIGINT) AS n FROM (SELECT t, n, unnest(range(1, len(t))) AS i FROM (SELECT {O.token_list('tokens')} AS t, n FROM {types})) GROUP BY 1, 2"


_TYPES = f"SELECT {O.hex_tokens('pretoken')} AS tokens, n FROM ({O.counts()})"


@query(_sql_pairs(f"({_TYPES})"))
def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pair_counts(B.hex_types(B.histogram(table(spark, sf_dir))))


@query(f"SELECT * FROM ({_sql_pairs(f'({_TYPES})')}) ORDER BY n DESC, left_hex DESC, right_hex DESC LIMIT 1")
def bpe_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_pair(B.pair_counts(B.hex_types(B.histogram(table(spark, sf_dir)))))


def _sql_train(k: int) -> str:
    parts = [f"s0 AS MATERIALIZED ({_TYPES})"]
    for i in range(k):
        parts.append(f"b{i} AS MATERIALIZED (SELECT * FROM ({_sql_pairs(f's{i}')}) ORDER BY n DESC, left_hex DESC, right_hex DESC LIMIT 1)")
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT replace(tokens, '<' || left_hex || '><' || right_hex || '>', '<' || left_hex || right_hex || '>') AS tokens, s{i}.n FROM s{i}, b{i})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {i} AS rank, left_hex, right_hex, n FROM b{i}" for i in range(k))


@query(_sql_train(TRAIN_MERGES))
def bpe_train_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed loop: as many merges as the SQL form unrolls."""
    merges = B.train_distributed(B.histogram(table(spark, sf_dir)), TRAIN_MERGES)
    return spark.createDataFrame([(i, a.hex().upper(), b.hex().upper(), n) for i, (a, b, n) in enumerate(merges)], "rank int, left_hex string, right_hex string, n long")


@query(f"SELECT {O.merged('tokens', MERGES)} AS tokens, CAST(sum(n) AS BIGINT) AS n FROM ({_TYPES}) GROUP BY 1")
def bpe_merge_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = B.hex_types(B.histogram(table(spark, sf_dir)))
    for a, b in MERGES:
        types = B.merge_step(types, a.hex().upper(), b.hex().upper())
    return types.groupBy("tokens").agg(F.sum("n").alias("n"))


@query(O.vocabulary([SPECIAL.encode(), *JOINED]))
def bpe_vocab_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base bytes, special tokens, then merged tokens: ids in this order."""
    tokens = [*(bytes([i]) for i in range(256)), SPECIAL.encode(), *JOINED]
    return B.vocab_table(spark, dict(enumerate(tokens))).select("token_id", F.hex("token").alias("token_hex"))


@query(None)
def bpe_train_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production trainer: a vocabulary of 400, special token included."""
    _, merges = B.train(table(spark, sf_dir), 400, [SPECIAL])
    return B.merges_table(spark, merges)


@query(None)
def bpe_train_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.train_by_group(table(spark, sf_dir), "lang", 300)


TRAINED = 1_000


@query(None)
def bpe_train_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of a thousand learned from all documents, and every document encoded with it."""
    docs = table(spark, sf_dir).select("doc_id", "text")
    vocab, merges = B.train(docs, TRAINED, [SPECIAL])
    done = C.encode_arrays(docs, C.Tokenizer(vocab, merges, [SPECIAL]))
    return done.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.octet_length("text").cast("long").alias("n_bytes"), _digest("tokens").alias("digest"))


def _digest(ids: str) -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


_IDS = f"list_transform(h, lambda x: CASE WHEN len(x) = 2 THEN CAST('0x' || x AS INTEGER) ELSE 255 + list_position({[t.hex().upper() for t in JOINED]}, x) END)"


# --- encoding and decoding -----------------------------------------------------------------


@query(LONG)
def bpe_encode_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_ids(spark, sf_dir)


@query(LONG)
def bpe_encode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.encode_long(table(spark, sf_dir), tokenizer(), form="fold")


@query(LONG)
def bpe_encode_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.encode_long(table(spark, sf_dir), tokenizer(), form="arrow")


_TWICE = f"text || '{SPECIAL}' || text"


@query(f"SELECT doc_id, CAST(len(h) AS BIGINT) AS n_tokens, CAST(len(list_filter(h, lambda x: x = '{SPECIAL.encode().hex().upper()}')) AS BIGINT) AS n_special FROM (SELECT doc_id, {O.encoded(_TWICE, MERGES, SPECIAL)} AS h FROM documents)")
def bpe_encode_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokenizer(special=True)
    docs = table(spark, sf_dir).select("doc_id", F.concat("text", F.lit(SPECIAL), "text").alias("text"))
    own = tok.ids[SPECIAL.encode()]
    return C.encode_arrays(docs, tok, form="chain").select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("tokens", lambda x: x == own)).cast("long").alias("n_special"))


@query(f"SELECT doc_id, CAST(len(h) AS BIGINT) AS n_tokens, decode(unhex(array_to_string(h, ''))) = text AS same, abs(length(decode(unhex(array_to_string(h, '')))) - length(text)) < 0.01 * length(text) AS near FROM (SELECT doc_id, text, {O.encoded('text', MERGES)} AS h FROM documents)")
def bpe_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = tokenizer()
    done = C.decode_arrays(C.encode_arrays(table(spark, sf_dir).select("doc_id", "text"), tok, form="chain"), tok)
    near = F.abs(F.length("decoded") - F.length("text")) < 0.01 * F.length("text")
    return done.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("same"), near.alias("near"))


@query(f"SELECT doc_id, decode(unhex(array_to_string(h, ''))) AS text FROM ({ENCODED}) WHERE len(h) > 0")
def bpe_decode_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From long form: ids in order of their place, joined with the vocabulary."""
    return C.decode_long(long_ids(spark, sf_dir), C.vocab_rows(spark, tokenizer()))


@query(f"SELECT token_id, token_hex, token_id < 128 OR token_id >= 256 AS whole FROM ({VOCAB})")
def decode_each_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token by itself: whether its bytes are whole UTF-8 characters."""
    v = C.vocab_rows(spark, tokenizer())
    return v.select("token_id", "token_hex", (~F.contains(T.to_text(F.unhex("token_hex")), F.lit(C.REPLACEMENT))).alias("whole"))


_ODD = f"SELECT doc_id, pos, CASE WHEN pos % 50 = 7 THEN 100000 + pos % 3 ELSE token_id END AS token_id FROM ({LONG})"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_ids(spark, sf_dir).withColumn("token_id", F.when(F.col("pos") % 50 == 7, 100000 + F.col("pos") % 3).otherwise(F.col("token_id")))


@query(f"SELECT token_id, count(*) AS n FROM ({_ODD}) ANTI JOIN ({VOCAB}) USING (token_id) GROUP BY token_id")
def unknown_token_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unknown_ids(_odd(spark, sf_dir), C.vocab_rows(spark, tokenizer())).groupBy("token_id").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, count(*) AS n_known, CAST(sum(len(token_hex)) / 2 AS BIGINT) AS n_bytes FROM ({_ODD}) JOIN ({VOCAB}) USING (token_id) GROUP BY doc_id")
def decode_skips_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _odd(spark, sf_dir).join(F.broadcast(C.vocab_rows(spark, tokenizer())), "token_id")
    return known.groupBy("doc_id").agg(F.count("*").alias("n_known"), (F.sum(F.length("token_hex")) / 2).cast("long").alias("n_bytes"))


_SOME = f"SELECT doc_id, {O.encoded('text', MERGES[:7])} AS h FROM documents"
_SOME_LONG = f"SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, token_id FROM (SELECT doc_id, unnest(h) AS token_hex, generate_subscripts(h, 1) AS pos FROM ({_SOME})) JOIN ({VOCAB}) USING (token_hex)"


@query(f"SELECT doc_id, count(*) AS n_differ FROM ({LONG}) a FULL JOIN ({_SOME_LONG}) b USING (doc_id, pos) WHERE a.token_id IS DISTINCT FROM b.token_id GROUP BY doc_id")
def tokenization_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, few = table(spark, sf_dir), tokenizer()
    few = C.Tokenizer(few.vocab, MERGES[:7])
    return C.n_different(docs.select("doc_id", "text"), tokenizer(), few)


@query(f"SELECT rank, left_hex, right_hex FROM (VALUES {', '.join(f'({i}, {chr(39)}{a.hex().upper()}{chr(39)}, {chr(39)}{b.hex().upper()}{chr(39)})' for i, (a, b) in enumerate([*MERGES, (b'q', b'zz'), (b'th', b'x')]))}) m(rank, left_hex, right_hex) WHERE left_hex IN (SELECT token_hex FROM ({VOCAB})) AND right_hex IN (SELECT token_hex FROM ({VOCAB})) AND left_hex || right_hex IN (SELECT token_hex FROM ({VOCAB}))")
def usable_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges whose sides and result are tokens; others, and entries that are no pair, are left out."""
    rows = [[a.hex().upper(), b.hex().upper()] for a, b in [*MERGES, (b"q", b"zz"), (b"th", b"x")]] + [["61"], ["61", "62", "63"]]
    m = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "rank int, m array<string>").filter(F.size("m") == 2)
    m = m.select("rank", F.element_at("m", 1).alias("left_hex"), F.element_at("m", 2).alias("right_hex"))
    v = F.broadcast(C.vocab_rows(spark, tokenizer()).select("token_hex"))
    for side in (F.col("left_hex"), F.col("right_hex"), F.concat("left_hex", "right_hex")):
        m = m.join(v, side == F.col("token_hex"), "left_semi")
    return m


# --- analytics -----------------------------------------------------------------------------


@query(f"SELECT token_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({LONG}) GROUP BY token_id")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted where the texts are, so that a token of every document is no hot key and no token is spread out."""
    return C.token_totals(table(spark, sf_dir), tokenizer())


@query(f"SELECT count(*) AS n, min(token_id) AS min_id, max(token_id) AS max_id, CAST(sum(token_id) AS BIGINT) AS sum_id, count(DISTINCT token_id) AS n_distinct FROM ({LONG})")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = C.token_totals(table(spark, sf_dir), tokenizer())
    return per.agg(F.sum("n").alias("n"), F.min("token_id").alias("min_id"), F.max("token_id").alias("max_id"), F.sum(F.col("token_id") * F.col("n")).alias("sum_id"), F.count("*").alias("n_distinct"))


@query(f"SELECT doc_id, n_bytes, n_tokens, CASE WHEN n_tokens > 0 THEN CAST(n_bytes AS DOUBLE) / n_tokens ELSE 0 END AS ratio FROM ({SIZES})")
def doc_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized(spark, sf_dir).select("doc_id", "n_bytes", "n_tokens", "ratio")


_TOTALS = "CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(sum(n_bytes) AS DOUBLE) / sum(n_tokens) AS ratio"


@query(f"SELECT {_TOTALS} FROM ({SIZES})")
def corpus_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir).select("n_bytes", "n_tokens", "ratio")


@query(f"SELECT lang, {_TOTALS} FROM ({SIZES}) GROUP BY lang")
def compression_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir, "lang").select("lang", "n_bytes", "n_tokens", "ratio")


@query(f"WITH r AS (SELECT lang, {_TOTALS} FROM ({SIZES}) GROUP BY lang) SELECT a.lang AS lang, round(a.ratio - b.ratio, {SHOWN}) AS difference, CASE WHEN a.ratio > b.ratio THEN 'better' WHEN a.ratio < b.ratio THEN 'worse' ELSE 'equal' END AS label FROM r a, r b WHERE b.lang = 'en' AND a.lang <> 'en'")
def compression_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against English: more bytes per token is the better compression."""
    r = totals(spark, sf_dir, "lang").select("lang", "ratio")
    base = r.filter("lang = 'en'").select(F.col("ratio").alias("base"))  # one row
    label = F.when(F.col("ratio") > F.col("base"), "better").when(F.col("ratio") < F.col("base"), "worse").otherwise("equal")
    return r.filter("lang <> 'en'").join(F.broadcast(base)).select("lang", F.round(F.col("ratio") - F.col("base"), SHOWN).alias("difference"), label.alias("label"))


@query(f"SELECT lang, CASE WHEN sum(n_tokens) > 0 THEN CAST(sum(n_chars) AS DOUBLE) / sum(n_tokens) ELSE 0 END AS chars_per_token, CAST(sum(n_bytes) AS DOUBLE) / 1048576 AS mb FROM ({SIZES}) GROUP BY lang")
def chars_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark, sf_dir, "lang").select("lang", "chars_per_token", (F.col("n_bytes") / 1048576).alias("mb"))


@query(f"SELECT max_id, n, coalesce(max_id <= 65535, true) AS fits_uint16, CASE WHEN coalesce(max_id <= 65535, true) THEN 'uint16' ELSE 'uint32' END AS dtype FROM (SELECT CAST(max(token_id) AS BIGINT) AS max_id, count(*) AS n FROM ({_ODD}))")
def uint16_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.token_width(_odd(spark, sf_dir))


@query(f"SELECT pretoken, n, n_chars FROM (SELECT *, CAST(length(pretoken) AS BIGINT) AS n_chars FROM ({O.counts()})) WHERE n_chars = (SELECT max(length(pretoken)) FROM ({O.counts()}))")
def longest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.longest(B.histogram(table(spark, sf_dir)), "pretoken").select("pretoken", "n", "n_chars")


@query(f"SELECT token_id, token_hex FROM ({VOCAB}) ORDER BY len(token_hex) DESC, token_id LIMIT 1")
def first_longest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vocab_rows(spark, tokenizer()).orderBy(F.length("token_hex").desc(), "token_id").limit(1)


@query(
    "SELECT count(*) AS n, CAST(sum(CAST(starts_with(p, ' ') AS INT)) AS BIGINT) AS leading_space, CAST(sum(CAST(regexp_matches(p, '[" + O.WS + "]') AS INT)) AS BIGINT) AS has_space,"
    " CAST(sum(CAST(regexp_full_match(replace(p, ' ', ''), '[\\p{L}\\p{N}]+') AS INT)) AS BIGINT) AS alphanumeric, CAST(sum(CAST(regexp_matches(p, '[^" + O.WS + "\\p{L}\\p{N}]') AS INT)) AS BIGINT) AS punctuation,"
    f' CAST(sum(CAST(length(p) > 20 AS INT)) AS BIGINT) AS "long" FROM (SELECT pretoken AS p FROM ({O.counts()}))'
)
def token_char_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.profile(B.histogram(table(spark, sf_dir)), "pretoken")


_EMPTY_LINES = "replace(text, chr(10), chr(10) || chr(10))"


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def _sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{O.WS}]+|[{O.WS}]+$', '', 'g')"


@query(f"SELECT doc_id, CAST(part - 1 AS INTEGER) AS part, {_sql_strip('p')} AS paragraph FROM (SELECT doc_id, unnest(string_split({_EMPTY_LINES}, chr(10) || chr(10))) AS p, generate_subscripts(string_split({_EMPTY_LINES}, chr(10) || chr(10)), 1) AS part FROM documents) WHERE length({_sql_strip('p')}) > 100")
def paragraph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paragraphs(_spread(spark, sf_dir))


_THIRDS = "regexp_replace(text, '[.]\\n', '.' || chr(10) || chr(10), 'g')"
_LINES = "SELECT doc_id, unnest(string_split({0}, chr(10))) AS line, generate_subscripts(string_split({0}, chr(10)), 1) - 1 AS line_no FROM documents"


@query(
    f"WITH l AS ({_LINES.format(_THIRDS)}), s AS (SELECT *, CAST(sum(CASE WHEN regexp_full_match(line, '[{O.WS}]*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS session FROM l)"
    f" SELECT doc_id, session, text FROM (SELECT doc_id, session, string_agg({_sql_strip('line')}, chr(10) ORDER BY line_no) AS text FROM s WHERE NOT regexp_full_match(line, '[{O.WS}]*') GROUP BY 1, 2) WHERE length(text) > 100"
)
def blank_line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", F.regexp_replace("text", "[.]\n", ".\n\n").alias("text"))
    return A.blank_line_documents(A.lines(docs))


@query(f"SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ({_LINES.format(_EMPTY_LINES)}) WHERE NOT regexp_full_match(line, '[{O.WS}]*') GROUP BY doc_id")
def drop_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lines(_spread(spark, sf_dir), drop_blank=True).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS n_chars FROM ({_LINES.format('text')})")
def complete_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lines(table(spark, sf_dir)).select("doc_id", "line_no", F.length("line").alias("n_chars"))


_MANY = f"replace(text, chr(10), '{SPECIAL}')"


@query(f"SELECT doc_id, CAST(n - 1 AS INTEGER) AS part, piece FROM (SELECT doc_id, unnest({O.pieces(_MANY, SPECIAL)}) AS piece, generate_subscripts({O.pieces(_MANY, SPECIAL)}, 1) AS n FROM documents)")
def special_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit(SPECIAL))
    return table(spark, sf_dir).select("doc_id", F.posexplode(T.with_specials(text, [SPECIAL])).alias("part", "piece"))


@query(f"SELECT pretoken, count(*) AS n FROM (SELECT unnest({O.pretokens('piece')}) AS pretoken FROM (SELECT unnest(string_split({_MANY}, '{SPECIAL}')) AS piece FROM documents)) GROUP BY pretoken")
def special_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training counts: special tokens part the text and are not counted."""
    docs = table(spark, sf_dir).select(F.replace("text", F.lit("\n"), F.lit(SPECIAL)).alias("text"))
    return B.histogram(docs, specials=[SPECIAL])


@query(f"SELECT doc_id, CAST((length({_MANY}) - length(replace({_MANY}, '{SPECIAL}', ''))) / {len(SPECIAL)} AS BIGINT) AS n_special FROM documents")
def special_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit(SPECIAL))
    return table(spark, sf_dir).select("doc_id", F.size(F.filter(T.with_specials(text, [SPECIAL]), lambda x: x == SPECIAL)).cast("long").alias("n_special"))


@query(f"SELECT token_id FROM ({O.vocabulary([SPECIAL.encode(), *JOINED])}) WHERE contains(token_hex, '3C7C') AND token_hex <> '{SPECIAL.encode().hex().upper()}'")
def marker_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, but the special ones, that hold the beginning of a marker: none."""
    v = bpe_vocab_k(spark, sf_dir)
    return v.filter(F.contains(F.unhex("token_hex"), F.lit(b"<|")) & (F.col("token_hex") != SPECIAL.encode().hex().upper())).select("token_id")


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview FROM documents ORDER BY md5('42/' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 10")
def doc_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hash_sample(table(spark, sf_dir), 10).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS row_no FROM (SELECT doc_id, md5('42/' || CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY h, doc_id LIMIT 25)")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample without replacement, numbered from 1; the sample is bounded, so one window may hold it."""
    from pyspark.sql import Window as W

    s = A.hash_sample(table(spark, sf_dir), 25).select("doc_id", F.md5(F.concat(F.lit("42/"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    return s.select("doc_id", F.row_number().over(W.orderBy("h", "doc_id")).cast("long").alias("row_no"))


@query("SELECT doc_id, text FROM (SELECT doc_id, substring(text, 1, CAST(least(length(text), 20000 - before) AS INT)) AS text, before FROM (SELECT doc_id, text, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)) WHERE before < 20000")
def char_limit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.char_limit(table(spark, sf_dir), 20_000)


@query("SELECT doc_id, substring(text, 1, 200) AS text FROM documents")
def size_limited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select("doc_id", F.substring("text", 1, 200).alias("text"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS part, substring(text, 1 + i * 1000, 1000) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents)")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select("doc_id", F.posexplode(A.chunks(F.col("text"), 1000)).alias("part", "piece"))


@query("SELECT doc_id, CAST(CASE WHEN contains(text, chr(10)) THEN length(text) - strpos(reverse(text), chr(10)) ELSE -1 END AS INTEGER) AS at FROM documents")
def last_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select("doc_id", T.last_newline(F.col("text")).cast("int").alias("at"))


_BY_LANG = {"en": "english", "de": "german"}


@query("SELECT coalesce(name, 'default') AS tokenizer, count(*) AS n FROM documents LEFT JOIN (VALUES ('en', 'english'), ('de', 'german')) t(lang, name) USING (lang) GROUP BY 1")
def tokenizer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer by key, the default where the key has none."""
    chosen = spark.createDataFrame(list(_BY_LANG.items()), "lang string, name string")
    return table(spark, sf_dir).join(F.broadcast(chosen), "lang", "left").groupBy(F.coalesce("name", F.lit("default")).alias("tokenizer")).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT range AS b, range BETWEEN 33 AND 126 OR range BETWEEN 161 AND 172 OR range BETWEEN 174 AND 255 AS seen FROM range(256)) SELECT CAST(b AS INTEGER) AS byte, chr(CAST(CASE WHEN seen THEN b ELSE 255 + sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (ORDER BY b) END AS INTEGER)) AS printable FROM b")
def byte_unicode_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(T.byte_characters())), "byte int, printable string")


@query("(SELECT DISTINCT source FROM documents WHERE lang = 'en' EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'es') UNION ALL (SELECT DISTINCT source FROM documents WHERE lang = 'es' EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'en')")
def source_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two key sets are equal if neither difference has a row."""
    d = table(spark, sf_dir)
    x, y = (d.filter(F.col("lang") == k).select("source").distinct() for k in ("en", "es"))
    return x.subtract(y).unionByName(y.subtract(x))


@query("SELECT name, replace(name, '_orig_mod.', '') AS plain FROM (VALUES ('_orig_mod.layers.0.ln1.weight'), ('token_embeddings.weight'), ('layers._orig_mod.1.w')) t(name)")
def state_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([("_orig_mod.layers.0.ln1.weight",), ("token_embeddings.weight",), ("layers._orig_mod.1.w",)], "name string")
    return artifacts.plain_names(s.withColumn("was", F.col("name"))).select(F.col("was").alias("name"), F.col("name").alias("plain"))


@query(f"SELECT 'documents' AS name, count(*) AS n_rows, CAST(sum(len(ids)) AS BIGINT) AS n_tokens, CAST(max(list_max(ids)) AS BIGINT) AS max_id, CASE WHEN max(list_max(ids)) > 65535 THEN 'uint32' ELSE 'uint16' END AS dtype, true AS stored FROM (SELECT {_IDS} AS ids FROM ({ENCODED}))")
def encoded_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded to a dataset and listed: rows, tokens, width, and whether it takes bytes on disk."""
    path = folder(spark)
    artifacts.save_tokens(C.encode_arrays(table(spark, sf_dir).select("doc_id", "text"), tokenizer()).select("doc_id", "tokens"), path)
    goes_at_exit(spark, path)
    return artifacts.catalog(spark, {"documents": path}).select("name", "n_rows", "n_tokens", "max_id", "dtype", (F.col("bytes") > 0).alias("stored"))


# --- streaming -----------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, sha256(array_to_string(ids, ',')) AS digest FROM (SELECT doc_id, {_IDS} AS ids FROM ({ENCODED}))")
def bpe_encode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files, encoded and written exactly once; equal to the batch result."""
    source = table(spark, sf_dir).select("doc_id", "text")
    src = written(source)
    path = src.inputFiles()[0].rsplit("/", 1)[0]
    stream = S.encoded(S.documents(spark, path, "doc_id long, text string"), tokenizer()).select("doc_id", "tokens")
    S.to_files(stream, f"{path}-out", f"{path}-state").awaitTermination()
    for made in (f"{path}-out", f"{path}-state"):
        goes_at_exit(spark, made)
    return spark.read.schema("doc_id long, tokens array<int>").parquet(f"{path}-out").select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), _digest("tokens").alias("digest"))


# --- training math -------------------------------------------------------------------------

D_OUT = 4
W1 = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(D_OUT)]
W3 = [[((i * 5 + j * 2) % 13 - 6) / 10 for j in range(64)] for i in range(D_OUT)]
W2 = [[((i * 3 + j * 5) % 7 - 3) / 10 for j in range(D_OUT)] for i in range(3)]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", X.doubles(F.col("embedding")).alias("x"))


def _spread_out(df: DataFrame, col: str, *keys: str, name: str = "y") -> DataFrame:
    return df.select(*keys, F.posexplode(col).alias("i", "v")).select(*keys, "i", (F.round("v", SHOWN) + 0.0).alias(name))


_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def _sql_matrix(w: list[list[float]]) -> str:
    return "[" + ", ".join("[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in r) + "]" for r in w) + "]"


def _sql_linear(x: str, w: list[list[float]]) -> str:
    return f"list_transform({_sql_matrix(w)}, lambda w: list_sum(list_transform(list_zip(w, {x}), lambda p: p[1] * p[2])))"


def _sql_out(source: str, keys: str = "vec_id") -> str:
    return f"SELECT {keys}, CAST(i - 1 AS INTEGER) AS i, round(y, {SHOWN}) + 0.0 AS y FROM (SELECT {keys}, unnest(y) AS y, generate_subscripts(y, 1) AS i FROM ({source}))"


@query(f"WITH {_V} {_sql_out(f'SELECT vec_id, {_sql_linear(chr(120), W1)} AS y FROM v')}")
def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread_out(_vectors(spark, sf_dir).select("vec_id", X.linear(F.col("x"), X.matrix(W1)).alias("y")), "y", "vec_id")


@query(f"WITH {_V} {_sql_out('SELECT vec_id, list_transform(x, lambda a: a / (1 + exp(-a))) AS y FROM v')}")
def silu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread_out(_vectors(spark, sf_dir).select("vec_id", X.silu(F.col("x")).alias("y")), "y", "vec_id")


_INNER = f"SELECT vec_id, {_sql_linear('x', W1)} AS a, {_sql_linear('x', W3)} AS b FROM v"
_GATED = f"SELECT vec_id, list_transform(list_zip(a, b), lambda p: p[1] / (1 + exp(-p[1])) * p[2]) AS g FROM ({_INNER})"


@query(f"WITH {_V} {_sql_out(f'SELECT vec_id, {_sql_linear(chr(103), W2)} AS y FROM ({_GATED})')}")
def swiglu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread_out(_vectors(spark, sf_dir).select("vec_id", X.swiglu(F.col("x"), X.matrix(W1), X.matrix(W2), X.matrix(W3)).alias("y")), "y", "vec_id")


@query(f"WITH {_V}, n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a)) / len(x) + 1e-5) AS r FROM v) {_sql_out('SELECT vec_id, list_transform(x, lambda a, i: a / r * (i / 64.0)) AS y FROM n')}")
def rmsnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain = F.array(*(F.lit((i + 1) / 64) for i in range(64)))
    return _spread_out(_vectors(spark, sf_dir).select("vec_id", X.rmsnorm(F.col("x"), gain).alias("y")), "y", "vec_id")


_SOFT = "SELECT vec_id, list_transform(e, lambda a: a / list_sum(e)) AS y FROM (SELECT vec_id, list_transform(x, lambda a: exp({0} * a - {0} * list_max(x))) AS e FROM v)"


@query(f"WITH {_V} {_sql_out(_SOFT.format('1000'))}")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of inputs a thousand times as large, which would overflow without the shift."""
    return _spread_out(_vectors(spark, sf_dir).select("vec_id", X.softmax(F.transform("x", lambda a: a * 1000)).alias("y")), "y", "vec_id")


@query(f"WITH {_V} SELECT label, round(avg(list_max(x) + ln(list_sum(list_transform(x, lambda a: exp(a - list_max(x))))) - x[label + 1]), {SHOWN}) AS loss, count(*) AS n FROM v GROUP BY label")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector as logits, its label as the target; mean loss of each label."""
    v = _vectors(spark, sf_dir).withColumn("loss", X.cross_entropy(F.col("x"), F.col("label")))
    return v.groupBy("label").agg(F.round(F.avg("loss"), SHOWN).alias("loss"), F.count("*").alias("n"))


SEQ = 8


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight vectors as sequences: (seq, x) with x in order. A sequence is bounded by its length."""
    v = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / SEQ).alias("seq"), "vec_id", "x")
    return v.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("r")).select("seq", F.col("r.vec_id").alias("ids"), F.col("r.x").alias("x"))


@query(
    f"WITH {_V}, s AS (SELECT q.vec_id, k.x, list_sum(list_transform(list_zip(q.x, k.x), lambda p: p[1] * p[2])) / sqrt(len(q.x)) AS s FROM v q JOIN v k ON q.vec_id // {SEQ} = k.vec_id // {SEQ} AND k.vec_id <= q.vec_id),"
    " w AS (SELECT vec_id, x, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s), p AS (SELECT vec_id, x, e / sum(e) OVER (PARTITION BY vec_id) AS w FROM w),"
    f" u AS (SELECT vec_id, w * unnest(x) AS y, generate_subscripts(x, 1) AS i FROM p) SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(sum(y), {SHOWN}) + 0.0 AS y FROM u GROUP BY vec_id, i"
)
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal: a place sees itself and those before it. Within a sequence's row, so that pairs are not spread out."""
    s = _sequences(spark, sf_dir).select("ids", "x", F.posexplode("x").alias("at", "q"))
    mask = F.transform("x", lambda _, i: i <= F.col("at"))
    out = s.select(F.get("ids", F.col("at")).alias("vec_id"), X.attention(F.col("q"), F.col("x"), F.col("x"), mask).alias("y"))
    return _spread_out(out, "y", "vec_id")


_ANGLE = "(vec_id % 16) / pow(10000.0, 2 * ((i - 1) // 2) / 64.0)"


@query(f"WITH {_V} {_sql_out(f'SELECT vec_id, list_transform(x, lambda a, i: CASE WHEN i % 2 = 1 THEN a * cos({_ANGLE}) - x[i + 1] * sin({_ANGLE}) ELSE x[i - 1] * sin({_ANGLE}) + a * cos({_ANGLE}) END) AS y FROM v')}")
def rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread_out(_vectors(spark, sf_dir).select("vec_id", X.rope(F.col("x"), F.col("vec_id") % 16).alias("y")), "y", "vec_id")


@query(f"WITH {_V} SELECT vec_id, CAST(h AS INTEGER) AS head, round(list_sum(x[h * 16 + 1 : h * 16 + 16]), {SHOWN}) + 0.0 AS total FROM (SELECT vec_id, x, unnest(range(4)) AS h FROM v)")
def head_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _vectors(spark, sf_dir).select("vec_id", F.posexplode(X.split_heads(F.col("x"), 4)).alias("head", "h"))
    return s.select("vec_id", "head", (F.round(X.total(F.col("h")), SHOWN) + 0.0).alias("total"))


@query(f"WITH {_V}, t AS ({LONG}) SELECT doc_id, pos, round(list_sum(x), {SHOWN}) + 0.0 AS total FROM t JOIN v ON v.vec_id = t.token_id")
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the embedding matrix by token id: the matrix has as many rows as the vocabulary."""
    ids = long_ids(spark, sf_dir)
    v = _vectors(spark, sf_dir).filter(F.col("vec_id") < 256 + len(MERGES)).select(F.col("vec_id").cast("int").alias("token_id"), (F.round(X.total(F.col("x")), SHOWN) + 0.0).alias("total"))
    return ids.join(F.broadcast(v), "token_id").select("doc_id", "pos", "total")


@query(f"SELECT CAST(range AS INTEGER) AS token_id, CAST(coalesce(n, 0) AS DOUBLE) AS grad FROM range({256 + len(MERGES)}) LEFT JOIN (SELECT token_id, count(*) AS n FROM ({LONG}) GROUP BY token_id) ON range = token_id")
def embedding_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.embedding_gradient(long_ids(spark, sf_dir), 256 + len(MERGES))


CONTEXT = 16


@query(
    f"SELECT doc_id, pos AS start, CAST(x_sum AS BIGINT) AS x_sum, CAST(y_sum AS BIGINT) AS y_sum FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n, sum(token_id) OVER (w ROWS BETWEEN CURRENT ROW AND {CONTEXT - 1} FOLLOWING) AS x_sum,"
    f" sum(token_id) OVER (w ROWS BETWEEN 1 FOLLOWING AND {CONTEXT} FOLLOWING) AS y_sum FROM ({LONG}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE pos < n - {CONTEXT}"
)
def lm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training window of every document: y is x one token further."""
    t = C.encode_arrays(table(spark, sf_dir).select("doc_id", "text"), tokenizer(), form="chain").select("doc_id", F.posexplode(X.windows(F.col("tokens"), CONTEXT)).alias("start", "w"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return t.select("doc_id", "start", add("w.x").alias("x_sum"), add("w.y").alias("y_sum"))


@query(f"SELECT pos AS start, count(*) AS n FROM (SELECT pos, count(*) OVER (PARTITION BY doc_id) AS n FROM ({LONG})) WHERE pos < n - {CONTEXT} GROUP BY pos")
def window_start_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a training window that starts at each place."""
    t = C.encode_arrays(table(spark, sf_dir).select("doc_id", "text"), tokenizer(), form="chain").select(F.size("tokens").alias("n")).filter(F.col("n") > CONTEXT)
    lengths = t.groupBy("n").agg(F.count("*").alias("docs"))
    return lengths.select("docs", F.explode(F.sequence(F.lit(0), F.col("n") - CONTEXT - 1)).alias("start")).groupBy("start").agg(F.sum("docs").alias("n"))


@query(f"WITH {_V}, n AS (SELECT sqrt(sum(list_sum(list_transform(x, lambda a: a * a)))) AS norm FROM v WHERE label <> 3) SELECT vec_id, round(CASE WHEN label = 3 THEN NULL ELSE list_sum(x) * least(1, 1.0 / (norm + 1e-6)) END, {SHOWN}) + 0.0 AS total FROM v, n")
def grad_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as gradients of as many parameters; those of label 3 have none."""
    g = _vectors(spark, sf_dir).select("vec_id", F.when(F.col("label") != 3, F.col("x")).alias("grad"))
    return TR.clip_gradients(g, 1.0, "vec_id").select("vec_id", (F.round(X.total(F.col("grad")), SHOWN) + 0.0).alias("total"))


@query(
    f"WITH {_V}, s AS (SELECT vec_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM v), g AS (SELECT *, sin(p * i) AS g FROM s), m AS (SELECT *, 0.9 * 0.1 + 0.1 * g AS m1, 0.999 * 0.01 + 0.001 * g * g AS v1 FROM g)"
    f" SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(p * (1 - 1e-3 * 0.01) - 1e-3 * (m1 / (1 - pow(0.9, 3))) / (sqrt(v1 / (1 - pow(0.999, 3))) + 1e-8), {SHOWN}) + 0.0 AS p, round(m1, {SHOWN}) + 0.0 AS m, round(v1, {SHOWN}) + 0.0 AS v FROM m"
)
def adamw_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third step, over parameters, gradients and moments as columns."""
    s = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "p"))
    s = s.select("vec_id", "i", "p", F.sin(F.col("p") * (F.col("i") + 1)).alias("g"), F.lit(0.1).alias("m"), F.lit(0.01).alias("v"), F.lit(2).alias("t"))
    out = TR.adamw_step(s)
    return out.select("vec_id", "i", *((F.round(c, SHOWN) + 0.0).alias(c) for c in ("p", "m", "v")))


@query(f"SELECT CAST(range AS INTEGER) AS step, round(CASE WHEN range < 7 THEN range / 7.0 WHEN range <= 21 THEN 0.1 + 0.5 * (1 + cos((range - 7) / 14.0 * pi())) * 0.9 ELSE 0.1 END, {SHOWN}) AS rate FROM range(25)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(25).select(F.col("id").cast("int").alias("step"), F.round(X.cosine_schedule(F.col("id"), 1.0, 0.1, 7, 21), SHOWN).alias("rate"))


def _attention_weights() -> dict:
    return {k: nn.truncated_normal((64, 64), 0.1, 0.3, i) for i, k in enumerate(("q", "k", "v", "o"))}


HEADS = 4


def _sql_mha(rotate: bool) -> str:
    """Projections, optional rotation within each head, causal attention by head, and the output projection."""
    w = _attention_weights()
    parts = ", ".join(f"{_sql_linear('x', w[k].tolist())} AS {k}" for k in ("q", "k", "v"))
    size = 64 // HEADS
    angle = f"pos / pow(10000.0, 2 * ((i - 1) // 2) / {size}.0)"
    turned = f"list_transform({{0}}, lambda a, i: CASE WHEN i % 2 = 1 THEN a * cos({angle}) - {{0}}[i + 1] * sin({angle}) ELSE {{0}}[i - 1] * sin({angle}) + a * cos({angle}) END)"
    turn = (lambda c: turned.format(c)) if rotate else (lambda c: c)
    return (
        f"WITH {_V}, p AS (SELECT vec_id, vec_id // {SEQ} AS seq, row_number() OVER (PARTITION BY vec_id // {SEQ} ORDER BY vec_id) - 1 AS pos, {parts} FROM v),"
        f" h0 AS (SELECT vec_id, seq, pos, h, q[h * {size} + 1 : (h + 1) * {size}] AS q, k[h * {size} + 1 : (h + 1) * {size}] AS k, v[h * {size} + 1 : (h + 1) * {size}] AS v FROM (SELECT *, unnest(range({HEADS})) AS h FROM p)),"
        f" h AS (SELECT vec_id, seq, pos, h, {turn('q')} AS q, {turn('k')} AS k, v FROM h0),"
        f" s AS (SELECT a.vec_id, a.seq, a.pos, a.h, b.v, list_sum(list_transform(list_zip(a.q, b.k), lambda p: p[1] * p[2])) / sqrt({size}) AS s FROM h a JOIN h b ON a.seq = b.seq AND a.h = b.h AND b.pos <= a.pos),"
        " e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id, h)) AS e FROM s), g AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, h) AS w FROM e),"
        " u AS (SELECT vec_id, seq, pos, h, generate_subscripts(v, 1) AS i, w * unnest(v) AS y FROM g), t AS (SELECT vec_id, seq, pos, h, i, sum(y) AS y FROM u GROUP BY ALL),"
        " x AS (SELECT vec_id, seq, pos, list(y ORDER BY h, i) AS x FROM t GROUP BY ALL)"
        f" {_sql_out('SELECT CAST(seq AS BIGINT) AS seq, CAST(pos AS INTEGER) AS pos, ' + _sql_linear('x', w['o'].tolist()) + ' AS y FROM x', 'seq, pos')}"
    )


def _mha(spark: SparkSession, sf_dir: str, rotate: bool) -> DataFrame:
    out = TR.self_attention(_sequences(spark, sf_dir), _attention_weights(), HEADS, rotate)
    return _spread_out(out.select("seq", F.posexplode("x").alias("pos", "row")), "row", "seq", "pos")


@query(_sql_mha(False))
def mha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mha(spark, sf_dir, False)


@query(_sql_mha(True))
def mha_rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mha(spark, sf_dir, True)


@query(None)
def transformer_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small transformer over 16-token windows that tile each document: best token and loss at each place, null only at a document's last."""
    tok = tokenizer()
    weights = nn.random_weights(256 + len(MERGES), 32, 2, 64)
    return TR.tiled_logits(table(spark, sf_dir), tok, weights, 2, 4, CONTEXT)
