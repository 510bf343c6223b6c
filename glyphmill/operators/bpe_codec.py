"""Encoding and decoding with a merge list.

Three physical forms of one result: ``chain`` nests one replace a merge (built-in, for up to
``CHAIN_LIMIT`` merges; over a whole text, with a mark between pre-tokens that no merge crosses), ``fold`` folds over the merge list (built-in, any length), ``arrow``
merges by rank with a memo in Arrow batches (long lists). None of them shuffles. The forms
agree where each merge's sides are made by earlier merges, as training gives them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written

CHAIN_LIMIT = 128
MEMO_ENTRIES = 300_000
#: Bytes of texts whose new pre-tokens are made together (at least one text); square of a vocabulary up to which ranks of pairs stand in one table.
TEXT_BYTES, DENSE_PAIRS = 1 << 20, 1 << 22
REPLACEMENT = "�"


class Tokenizer:
    """A vocabulary, a merge list and special tokens; special tokens that the vocabulary lacks get the next ids."""

    def __init__(self, vocab: dict[int, bytes], merges: Iterable[tuple[bytes, bytes]], specials: Sequence[str] | None = None):
        self.vocab, self.merges, self.specials = dict(vocab), list(merges), list(specials or [])
        known = set(self.vocab.values())
        for s in self.specials:
            if (raw := s.encode()) not in known:
                self.vocab[max(self.vocab, default=-1) + 1] = raw
                known.add(raw)
        self.ids = {t: i for i, t in self.vocab.items()}  # of equal tokens the last id counts
        # a merge of which a side or the result is no token cannot be applied
        self.usable = [(a, b) for a, b in self.merges if a in self.ids and b in self.ids and a + b in self.ids]
        self.rank = {m: r for r, m in reversed(list(enumerate(self.usable)))}

    def id_of(self, token: bytes) -> int:
        """A byte that the vocabulary lacks stands for itself."""
        return self.ids.get(token, token[0] if len(token) == 1 else -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged everywhere, until none has a rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, pair = min((self.rank.get(p, 1 << 60), p) for p in zip(parts, parts[1:], strict=False))
            if rank == 1 << 60:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.id_of(p) for p in parts]


def _ids(tokens: Column, tok: Tokenizer) -> Column:
    """ARRAY<INT> of hex tokens; a byte that the vocabulary lacks stands for itself."""
    own = {t.hex().upper(): i for t, i in tok.ids.items() if not (len(t) == 1 and t[0] == i)}
    plain = lambda h: F.conv(h, 16, 10).cast("int")
    if not own:
        return F.transform(T.token_list(tokens), plain)
    table = F.create_map(*(F.lit(x) for kv in own.items() for x in kv))
    return F.transform(T.token_list(tokens), lambda h: F.coalesce(F.element_at(table, h), plain(h)))


def _merged(piece: Column, tok: Tokenizer, form: str) -> Column:
    tokens = T.hex_tokens(piece)
    hexed = [(a.hex().upper(), b.hex().upper()) for a, b in tok.usable]
    if form == "chain":
        for a, b in hexed:
            tokens = T.apply_merge(tokens, a, b)
        return tokens
    steps = F.array(*(F.struct(F.lit(f"<{a}><{b}>").alias("f"), F.lit(f"<{a}{b}>").alias("t")) for a, b in hexed))
    return F.aggregate(steps, tokens, lambda s, m: F.replace(s, m["f"], m["t"])) if hexed else tokens


#: First of the characters that stand for merged tokens; a byte stands for itself.
FIRST_MERGED = 0xE000


def _joined(marked: Column, usable: Sequence[tuple[bytes, bytes]], char: dict[bytes, str]) -> Column:
    """Marked text, a character a token, after merges, whose tokens get the next characters in ``char``."""
    for left, right in usable:
        if left in char and right in char:  # a side that no merge has made occurs nowhere
            joined = char.setdefault(left + right, chr(FIRST_MERGED + len(char) - 256))
            marked = F.replace(marked, F.lit(char[left] + char[right]), F.lit(joined))
    return marked


def _bytes_marked(piece: Column) -> Column:
    """The piece's bytes read as Latin-1, so that no other character can occur, with the mark behind each pre-token."""
    return F.decode(T.marked_pretokens(piece).cast("binary"), "ISO-8859-1")


def _whole(piece: Column, tok: Tokenizer) -> Column:
    """ARRAY<INT> of a whole piece that does not hold the mark: a character a token, so that a merge replaces two by one."""
    char = {bytes([b]): chr(b) for b in range(256)}
    text = F.replace(_joined(_bytes_marked(piece), tok.usable, char), F.lit(T.MARK), F.lit(""))
    table = F.array(*(F.lit(tok.id_of(t)) for t in char))
    ids = F.transform(F.split(text, ""), lambda c: F.get(table, F.when(F.ascii(c) < FIRST_MERGED, F.ascii(c)).otherwise(F.ascii(c) - (FIRST_MERGED - 256))))
    return F.when(piece == "", F.array().cast("array<int>")).otherwise(ids)


def encode_long(df: DataFrame, tok: Tokenizer, id_col: str = "doc_id", text_col: str = "text", form: str = "chain") -> DataFrame:
    """(``id_col``, pos, token_id): ids are made inside of each row and then spread out, without a shuffle."""
    # an inner generator would have the ids made once more, to leave out rows without any before it
    return encode_arrays(df.select(id_col, text_col), tok, text_col, "_ids", form).select(id_col, F.posexplode_outer("_ids").alias("pos", "token_id")).filter("pos IS NOT NULL")


def _special_id(piece: Column, tok: Tokenizer) -> Column:
    if not tok.specials:
        return F.lit(None).cast("int")
    table = F.create_map(*(F.lit(x) for s in tok.specials for x in (s, tok.ids[s.encode()])))
    return F.element_at(table, piece)


def encode_arrays(df: DataFrame, tok: Tokenizer, text_col: str = "text", out_col: str = "tokens", form: str = "arrow") -> DataFrame:
    """``df`` with ARRAY<INT> ids of each row's text, in place: no shuffle in any form."""
    if form == "chain" and len(tok.usable) > CHAIN_LIMIT:
        form = "fold"
    if form != "arrow":
        special = (lambda p: p.isin(tok.specials)) if tok.specials else (lambda p: F.lit(False))
        one_by_one = lambda p: F.flatten(F.transform(T.pretokens(p), lambda w: _ids(_merged(w, tok, form), tok)))
        ids = one_by_one
        if form == "chain" and not any(T.MARK.encode() in a + b for a, b in tok.usable):
            ids = lambda p: F.when(F.contains(p, F.lit(T.MARK)), one_by_one(p)).otherwise(_whole(p, tok))
        if not tok.specials:
            return df.withColumn(out_col, F.when(F.col(text_col).isNotNull(), ids(F.col(text_col))))
        of_piece = lambda p: F.when(special(p), F.array(_special_id(p, tok))).otherwise(ids(p))
        return df.withColumn(out_col, F.flatten(F.transform(T.with_specials(F.col(text_col), tok.specials), of_piece)))

    return _encode_arrow(df, tok, text_col, out_col)


class Words:
    """Ids of many pre-tokens at once: in each round every word makes its pair of lowest rank everywhere, until none has a pair with a rank."""

    def __init__(self, tok: Tokenizer):
        number = {bytes([b]): b for b in range(256)}
        for a, b in tok.rank:
            for t in (a, b, a + b):
                number.setdefault(t, len(number))
        self.size, self.never = len(number), len(tok.rank)
        self.ids = np.array([tok.id_of(t) for t in number], np.int32)
        pairs = sorted((number[a] * self.size + number[b], r, number[a + b]) for r, (a, b) in enumerate(sorted(tok.rank, key=tok.rank.__getitem__)))
        self.key, self.rank = np.array([k for k, _, _ in pairs], np.int64), np.array([r for _, r, _ in pairs], np.int32)
        self.made = np.zeros(self.never + 1, np.int32)
        self.made[self.rank] = [z for _, _, z in pairs]
        self.table = None
        if self.size * self.size <= DENSE_PAIRS:
            self.table = np.full(self.size * self.size, self.never, np.int32)
            self.table[self.key] = self.rank

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return np.where(self.key[at] == key, self.rank[at], self.never) if len(self.key) else np.full(len(key), self.never, np.int32)

    def __call__(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word, as native 32-bit integers."""
        token = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            rank = np.full(len(token), self.never, np.int32)  # of the pair that begins at a place
            rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(token[:-1].astype(np.int64) * self.size + token[1:]), self.never)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(token))))
            ended = least == self.never
            if ended.any():
                done.append((word[ended], token[ended]))
                token, word, rank, least = (x[~ended] for x in (token, word, rank, least))
            at = np.flatnonzero(rank == least)
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1])) if len(at) else at
            at = at[(at - np.repeat(at[begins], np.diff(np.append(begins, len(at))))) % 2 == 0]  # of a run every other place, from its left
            token[at] = self.made[least[at]]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, word = token[keep], word[keep]
        word, token = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (word, token)
        raw = self.ids[token[np.argsort(word, kind="stable")]].tobytes()
        end = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [raw[i:j] for i, j in zip([0, *end], end, strict=False)]


class Encoder:
    """Encodes texts; ids of pre-tokens are remembered, and those that are new in some texts are made together."""

    def __init__(self, tok: Tokenizer):
        import regex

        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(set(tok.specials), key=lambda s: (-len(s), s))) + ")") if tok.specials else None
        self.find = regex.compile(T.PATTERN).findall
        self.own = {s: np.int32(tok.ids[s.encode()]).tobytes() for s in tok.specials}
        self.words, self.memo = Words(tok), dict(self.own)

    def _parts(self, text: str) -> list[str]:
        """Pre-tokens, and special tokens, which no pre-token between them equals."""
        if self.cut is None:
            return self.find(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.own:
                out.append(part)
            else:
                out += self.find(part)
        return out

    def __call__(self, texts: Iterable[str | None]) -> list[np.ndarray | None]:
        parts = [None if x is None else self._parts(x) for x in texts]
        there = set().union(*(p for p in parts if p))
        new = [w for w in there if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_ENTRIES + len(self.own):
            self.memo = dict(self.own)
            new = [w for w in there if w not in self.memo]
        if new:
            self.memo.update(zip(new, self.words([w.encode() for w in new]), strict=True))
        of = self.memo.__getitem__
        return [None if p is None else np.frombuffer(b"".join(map(of, p)), np.int32) for p in parts]

    def some(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray | None]]]:
        """Ids of a column's texts, some at a time, with the first row."""
        i, rows = 0, len(texts)
        size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) if rows else ()
        while i < rows:
            before = int(size[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(size, before + TEXT_BYTES, "right")))
            yield i, self(texts.slice(i, j - i).to_pylist())
            i = j


def _lists(ids: Sequence[np.ndarray | None]) -> pa.Array:
    """list<int32> of arrays; none of them is spread out into Python's numbers."""
    size = np.array([0 if x is None else len(x) for x in ids], np.int64)
    known = [x for x in ids if x is not None]
    values = pa.array(np.concatenate(known) if known else np.zeros(0, np.int32), pa.int32())
    missing = pa.array([x is None for x in ids], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values, mask=missing)


def _encode_arrow(df: DataFrame, tok: Tokenizer, text_col: str, out_col: str) -> DataFrame:
    from pyspark.sql import types as ST

    where = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tok)
        for b in batches:
            for i, ids in encode.some(b.column(where)):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, len(ids)) for c in b.columns), _lists(ids)], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, ST.StructType([*df.schema.fields, ST.StructField(out_col, ST.ArrayType(ST.IntegerType()))]))


def encode_iterable(texts: Iterable[str], tok: Tokenizer) -> Iterator[int]:
    """Lazy ids of a stream of texts; a text is one record, so that chunking does not change its tokens."""
    encode = Encoder(tok)
    for t in texts:
        yield from encode([t])[0].tolist()


def encode_text(text: str, tok: Tokenizer) -> list[int]:
    return Encoder(tok)([text])[0].tolist()


def decode_ids(ids: Iterable[int], tok: Tokenizer) -> str:
    """Unknown ids are left out; malformed UTF-8 becomes U+FFFD."""
    return b"".join(tok.vocab[i] for i in ids if i in tok.vocab).decode("utf-8", errors="replace")


def vocab_rows(spark: SparkSession, tok: Tokenizer) -> DataFrame:
    """(token_id, token_hex): a row per token of a fixed vocabulary."""
    return spark.createDataFrame([(i, t.hex().upper()) for i, t in tok.vocab.items()], "token_id int, token_hex string")


def decode_long(ids: DataFrame, vocab: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, text) of (id, pos, token_id): ids that are no tokens are skipped. The vocabulary is small and fixed."""
    known = ids.join(F.broadcast(vocab), "token_id")
    joined = known.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_hex"))), lambda s: s["token_hex"]), "").alias("h"))
    return joined.select(id_col, T.to_text(F.unhex("h")).alias("text"))


#: Tokens of a vocabulary that is written into the plan as a literal; larger ones are looked up in Arrow batches.
LITERAL_VOCABULARY = 4096


def decode_arrays(df: DataFrame, tok: Tokenizer, ids_col: str = "tokens", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each row's ids, in place: no shuffle. Ids that are no tokens are skipped."""
    top = max(tok.vocab, default=-1)
    if top < LITERAL_VOCABULARY:
        table = F.array(*(F.lit(tok.vocab[i].hex()) if i in tok.vocab else F.lit(None).cast("string") for i in range(top + 1)))
        return df.withColumn(out_col, T.to_text(F.unhex(F.array_join(F.transform(ids_col, lambda i: F.get(table, i)), ""))))
    from pyspark.sql import types as ST

    where = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [decode_ids(x, tok) if x is not None else None for x in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, ST.StructType([*df.schema.fields, ST.StructField(out_col, ST.StringType())]))


def token_totals(df: DataFrame, tok: Tokenizer, text_col: str = "text") -> DataFrame:
    """(token_id, n, n_docs): how often each token stands in all texts, and in how many rows.

    Texts are encoded and counted inside of an Arrow batch, which gives a row per token of the vocabulary at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tok)
        top = max(tok.ids.values(), default=0) + 1
        for b in batches:
            n, docs = np.zeros(top, np.int64), np.zeros(top, np.int64)
            for _, some in encode.some(b.column(0)):
                for x in some:
                    if x is not None and len(x):
                        own = np.bincount(x, minlength=top)
                        n += own
                        docs += own > 0
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen]), pa.array(docs[seen])], names=["token_id", "n", "n_docs"])

    parts = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token_id int, n long, n_docs long")
    return parts.groupBy("token_id").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def sizes_of_types(counts: DataFrame, tok: Tokenizer, *by: str) -> DataFrame:
    """(``by``, n_bytes, n_chars, n_tokens) of a histogram (``by``, pretoken, n): each distinct pre-token is encoded once."""
    types = counts.groupBy("pretoken").agg(F.sum("n").alias("n")).select("pretoken") if by else counts.select("pretoken")
    done = encode_arrays(types, tok, "pretoken", "ids", "chain").select("pretoken", F.size("ids").cast("long").alias("k"))
    rows = counts.join(done, "pretoken")
    n = F.col("n")
    return rows.groupBy(*by).agg(F.sum(n * F.octet_length("pretoken")).alias("n_bytes"), F.sum(n * F.length("pretoken")).alias("n_chars"), F.sum(n * F.col("k")).alias("n_tokens"))


def unknown_ids(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    return ids.join(F.broadcast(vocab.select("token_id")), "token_id", "left_anti")


def difference(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Places at which two tokenisations (id, pos, token_id) differ: (id, pos, left_id, right_id)."""
    x, y = a.withColumnRenamed("token_id", "left_id"), b.withColumnRenamed("token_id", "right_id")
    return x.join(y, [id_col, "pos"], "full_outer").filter(~F.col("left_id").eqNullSafe(F.col("right_id")))


def _differing(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    return int((a[:n] != b[:n]).sum()) + abs(len(a) - len(b))


def _places_of_rows(df: DataFrame, a: Tokenizer, b: Tokenizer, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, n_differ, n_both) of each row: places at which two tokenisations of its text differ, and tokens of both together.

    The text is cut into pre-tokens once, and merges that both lists begin with are made once. Tokens are compared as characters
    of two bytes in Arrow batches; none is spread out.
    """
    if a.specials or b.specials or max(len(a.usable), len(b.usable)) > CHAIN_LIMIT or any(T.MARK.encode() in x + y for t in (a, b) for x, y in t.usable):
        both = encode_arrays(encode_arrays(df.select(id_col, text_col), a, text_col, "_a"), b, text_col, "_b").select(id_col, "_a", "_b")
        read = lambda col, _: [None if x is None else np.array(x, np.int64) for x in col.to_pylist()]
        ids = [None, None]
    else:
        text = F.col(text_col).cast("string")
        same = next((k for k, (x, y) in enumerate(zip(a.usable, b.usable, strict=False)) if x != y), min(len(a.usable), len(b.usable)))
        char = {bytes([k]): chr(k) for k in range(256)}
        # a text that holds the mark is encoded by pre-token
        odd = F.contains(text, F.lit(T.MARK))
        by_word = lambda tok: F.flatten(F.transform(T.pretokens(text), lambda w: _ids(_merged(w, tok, "chain"), tok)))
        rows = df.select(id_col, *(F.when(odd, by_word(t)).alias(c) for t, c in ((a, "_a"), (b, "_b"))), F.when(~odd, _bytes_marked(text)).alias("_m"))
        # each of these columns is read more than once, so that Spark keeps the projections apart
        rows = rows.withColumn("_m", _joined(F.col("_m"), a.usable[:same], char))
        of = [dict(char), dict(char)]
        chars = [F.encode(F.replace(_joined(F.col("_m"), t.usable[same:], own), F.lit(T.MARK), F.lit("")), "UTF-16LE") for t, own in zip((a, b), of, strict=True)]
        both = rows.select(id_col, F.col("_a").alias("_ia"), F.col("_b").alias("_ib"), chars[0].alias("_a"), chars[1].alias("_b"))
        ids = [np.array([t.id_of(x) for x in own], np.int64) for t, own in zip((a, b), of, strict=True)]

        def read(col: pa.Array, table: np.ndarray) -> list[np.ndarray | None]:
            codes = [None if x is None else np.frombuffer(x, "<u2") for x in col.to_pylist()]
            return [None if x is None else table[np.where(x < FIRST_MERGED, x, x - (FIRST_MERGED - 256))] for x in codes]

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):  # few rows' tokens are held at a time
                x, y = (read(batch.column(c), t) for c, t in zip(("_a", "_b"), ids, strict=True))
                if "_ia" in batch.schema.names:
                    x, y = ([k if k is not None else (None if i is None else np.array(i, np.int64)) for k, i in zip(z, batch.column(c).to_pylist(), strict=True)] for z, c in ((x, "_ia"), (y, "_ib")))
                n = [0 if k is None else _differing(k, m) for k, m in zip(x, y, strict=True)]
                total = [0 if k is None else len(k) + len(m) for k, m in zip(x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=["id", "n_differ", "n_both"])

    return both.mapInArrow(run, f"id {kind}, n_differ long, n_both long").withColumnRenamed("id", id_col)


def n_different(df: DataFrame, a: Tokenizer, b: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_differ): how many rows ``difference`` has for each id, without the ids that it has none of.

    A row whose id stands on no other row is compared in place. Rows of one id meet place by place, each of one tokenisation
    with each of the other; only these are spread out, and counted rather than joined. A null id meets nothing.
    """
    again = written(df.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col))
    some = not again.isEmpty()
    there = F.col(id_col).isNotNull()
    single = df.filter(there).join(again, id_col, "left_anti") if some else df.filter(there)
    rows = _places_of_rows(single.select(id_col, text_col), a, b, id_col, text_col)
    lone = _places_of_rows(df.filter(~there).select(id_col, text_col), a, b, id_col, text_col).groupBy(id_col).agg(F.sum("n_both").alias("n_differ"))
    out = rows.select(id_col, "n_differ").unionByName(lone)
    if some:
        more = df.join(again, id_col, "left_semi").select(id_col, text_col)
        x, y = (encode_long(more, t, id_col, text_col).withColumns({"_x": F.lit(int(first)), "_y": F.lit(int(not first))}) for t, first in ((a, True), (b, False)))
        tokens = x.unionByName(y).groupBy(id_col, "pos", "token_id").agg(F.sum("_x").alias("x"), F.sum("_y").alias("y"))
        places = tokens.groupBy(id_col, "pos").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("equal"))
        n = F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("x") * F.col("y") - F.col("equal")).otherwise(F.col("x") + F.col("y"))
        out = out.unionByName(places.groupBy(id_col).agg(F.sum(n).alias("n_differ")))
    return out.filter("n_differ > 0")
