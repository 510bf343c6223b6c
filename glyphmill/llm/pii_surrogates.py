"""Keyed surrogates for personal data. DataFrame and SQL functions only.

Entities are found by one pattern: e-mail addresses, secrets, IBANs, IP addresses (4 and 6), card, phone and
social security numbers, and names behind a form of address. An entity's canonical form (digits of
a number, lower case of an address, each part of a name by itself) is what coreference goes by:
every mention of it, in any format and any document, gets the same surrogate.

A surrogate is drawn from a keyed hash of kind, canonical form and attempt, and keeps the kind's
build: letters and digits in place, Luhn sums, octets, names of the same gender and script. All
distinct entities are then held against each other: where two share a surrogate, or a surrogate is
some real entity, all but the first draw again, until none is left. Only entities are shuffled
for that. Texts without entities are passed through as they are.

No pattern repeats a group but possessively, which Java's engine does in a loop, so that a text of any length can be scanned.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_join, table

#: Forms of address.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Г-жа", "Κυρία")
EITHER = ("Dr", "Prof")
#: What may stand in lower case before a surname.
PARTICLES = ("de", "del", "della", "di", "da", "do", "dos", "du", "la", "le", "las", "los", "van", "von", "der", "den", "ten", "ter", "zu", "zur", "af", "av", "bin", "ibn", "y", "e")
#: Given names by gender and script, and syllables that surnames, and more given names, are made of.
GIVEN = {
    "given_m_latin": "Adrian Anton Bruno Carl Daniel Edgar Felix Georg Hugo Ivan Julian Karl Leon Marco Nils Oscar Paul Robert Simon Thomas Victor Walter".split(),
    "given_f_latin": "Alice Anna Berta Clara Diana Elena Flora Greta Hanna Irene Julia Klara Laura Maria Nina Olga Paula Rosa Sofia Teresa Vera Wanda".split(),
    "given_m_cyrillic": "Антон Борис Виктор Григорий Дмитрий Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей Тимур".split(),
    "given_f_cyrillic": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Раиса Софья".split(),
    "given_m_greek": "Ανδρέας Γιώργος Δημήτρης Κώστας Λευτέρης Μάρκος Νίκος Παύλος Σπύρος Φώτης".split(),
    "given_f_greek": "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
SYLLABLES = {
    "latin": "bar bel cor dan dor fel gar hol kel lan mar nor pel ran sel tor val win zan mer".split(),
    "cyrillic": "бар вел гор дан дор зим кал лан мар нор пол рам сел тор вал мер".split(),
    "greek": "βαλ γορ δαν ζερ θαλ καρ λεν μαρ νορ παλ ρεν σαλ τορ φελ χαρ".split(),
}
ENDINGS = {"m_latin": "o", "f_latin": "a", "m_cyrillic": "он", "f_cyrillic": "а", "m_greek": "ος", "f_greek": "α"}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = r"[0-9a-fA-F]{1,4}"
_TITLE = "|".join((*MALE, *FEMALE, *EITHER))
_LETTER = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}]"
_CAPITAL = r"[\p{Lu}&&[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]]"
_NAME = rf"(?!(?:{_TITLE})(?!\p{{L}}))(?:[dl]['’])?{_CAPITAL}{_LETTER}*+(?:['’]{_CAPITAL}{_LETTER}*+|-{_LETTER}++){{0,6}}+"
_PARTICLE = rf"(?:{'|'.join(PARTICLES)})"
_INITIALS = r"(?:\p{Lu}\.){1,3}"
#: In this order, the first that matches at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": rf"{_B}(?:[0-9a-fA-F]{{32,}}+|AKIA[0-9A-Z]{{16}}|gh[a-z]_[0-9A-Za-z]{{30,}}+|sk-[0-9A-Za-z_-]{{20,}}+){_E}",
    "iban": rf"{_B}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9a-fA-F:]{{0,38}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,5}}{_HEX}|(?:{_HEX}:){{2,7}}:)(?![\p{{L}}\p{{N}}:])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "ssn": rf"{_B}(?<!-)\d{{3}}-\d{{2}}-\d{{4}}{_E}(?!-)",
    "card": rf"{_B}(?<!\+)\d(?:[ -]?\d){{12,18}}{_E}",
    # +country code; three, three and four digits; French pairs; German area codes; Spanish threes and pairs
    "phone": rf"(?<![\p{{L}}\p{{N}}+])(?:\+\d(?:[ .()-]{{0,2}}\d){{7,14}}|(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]\d{{4}}|0[1-9](?:[ .-]\d{{2}}){{4}}|0\d{{2,4}}[ /-]\d{{3,4}}[ -]?\d{{3,4}}|[6-9]\d{{2}}[ -]\d{{3}}[ -]\d{{3}}|[6-9]\d{{2}}(?: \d{{2}}){{3}}){_E}",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.? (?:{_INITIALS} ){{0,3}}(?:{_PARTICLE} ){{0,3}}{_NAME}(?:(?: {_INITIALS}){{0,3}}(?: {_PARTICLE}){{0,3}} {_NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity holds one of these; most texts hold none.
HINT = r"[0-9@]|sk-|AKIA|gh[a-z]_|[a-fA-F]{32}|(?:" + _TITLE + r")\.? [\p{L}]"
#: Setting of the session that holds the key.
KEY_SETTING = "spark.glyphmill.pii.key"
#: Draws in a row that may leave as many clashes as before: then a kind has more entities than its format can tell apart.
STALLED = 12


def session_key(spark: SparkSession) -> str:
    """The key set under ``KEY_SETTING``; else a random one, drawn once for the session, so that nobody can compute
    surrogates from entities. Sessions that are to agree must be given the same key."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _quote(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _names(xs: list[str] | tuple[str, ...]) -> str:
    return "array(" + ", ".join(map(_quote, xs)) + ")"


def _kind() -> str:
    """Kind of a mention m: the first pattern that matches all of it."""
    cases = " ".join(f"WHEN m RLIKE {_quote(f'^(?:{p})$')} THEN '{k}'" for k, p in PATTERNS.items() if k != "person")
    return f"CASE {cases} ELSE 'person' END"


def _script(x: str) -> str:
    return f"CASE WHEN {x} RLIKE '\\\\p{{IsCyrillic}}' THEN 'cyrillic' WHEN {x} RLIKE '\\\\p{{IsGreek}}' THEN 'greek' ELSE 'latin' END"


def _slots() -> str:
    """Parts of a name mention m behind its form of address: (token, part of it between hyphens, whether it is an entity)."""
    unit = "NOT (t RLIKE '^(\\\\p{Lu}[.])+$' OR t RLIKE '^\\\\p{Ll}+$')"  # neither initials nor a particle
    return f"flatten(transform(slice(split(m, ' '), 2, 99), (t, i) -> transform(split(t, '-'), c -> struct(i AS i, c AS c, {unit} AS unit))))"


def _units() -> str:
    """Entities of a mention: (kind, canonical form); a name has one for each part. ``slots`` is a column."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    title = "regexp_replace(split(m, ' ')[0], '[.]$', '')"
    named = "filter(slots, x -> x.unit)"
    last = f"array_max(transform({named}, x -> x.i))"
    # behind a title that either gender has, a given name's ending decides
    gender = f"CASE WHEN array_contains({_names(MALE)}, {title}) THEN 'm' WHEN array_contains({_names(FEMALE)}, {title}) THEN 'f' WHEN {named}[0].c RLIKE '[aAeEáéаАяЯиИαΑάηΗή]$' THEN 'f' ELSE 'm' END"
    name = f"transform({named}, x -> struct(IF(x.i = {last}, 'surname_', concat('given_', {gender}, '_')) || {_script('x.c')} AS kind, lower(x.c) AS canon))"
    # the country code 1 is as often left out as not; others belong to the number
    phone = f"IF(m LIKE '+1%' AND length({digits}) = 11, right({digits}, 10), {digits})"
    plain = {"email": "lower(m)", "secret": "IF(m RLIKE '^[0-9a-fA-F]+$', lower(m), m)", "ip": "m", "ipv6": "lower(m)", "iban": "replace(m, ' ', '')", "ssn": digits, "card": digits, "phone": phone}
    cases = " ".join(f"WHEN '{k}' THEN array(struct(kind AS kind, {c} AS canon))" for k, c in plain.items())
    return f"CASE kind {cases} ELSE {name} END"


def _seed(key: str) -> str:
    return f"sha2(concat_ws('|', {_quote(key)}, kind, canon, cast(attempt AS string), {_quote(key)}), 256)"


def _draw() -> str:
    """Surrogate of (kind, canon, attempt) in canonical form, from the column ``seed``. What can grow does so with the attempt."""
    # v(i): a keyed number below 65,536 for place i; every 16 places have a hash of their own
    v = "cast(conv(substr(sha2(concat_ws('|', seed, cast(i DIV 16 AS string)), 256), 1 + (i % 16) * 4, 4), 16, 10) AS int)"
    greek, cyrillic = LETTERS["greek"], LETTERS["cyrillic"]
    shaped = f"""array_join(transform(split(canon, ''), (c, i) -> CASE
        WHEN i < keep THEN c
        WHEN c RLIKE '[0-9]' THEN cast({v} % 10 AS string)
        WHEN c RLIKE '[A-Z]' THEN char(65 + {v} % 26)
        WHEN c RLIKE '[а-яё]' THEN substr('{cyrillic}', 1 + {v} % {len(cyrillic)}, 1)
        WHEN c RLIKE '[α-ω]' THEN substr('{greek}', 1 + {v} % {len(greek)}, 1)
        WHEN c RLIKE '\\\\p{{L}}' THEN char(97 + {v} % 26)
        ELSE c END), '')"""
    hexed = f"array_join(transform(split(canon, ''), (c, i) -> IF(i < keep OR c = ':', c, lower(hex({v} % 16)))), '')"
    whole = f"array_join(transform(split(canon, ''), (c, i) -> IF(i < keep, c, cast(IF(i = keep AND kind = 'phone', 2 + {v} % 8, {v} % 10) AS string))), '')"
    octets = f"array_join(transform(sequence(0, 3), i -> cast(1 + {v} % 254 AS string)), '.')"
    pick = lambda xs: f"element_at({_names(xs)}, 1 + {v} % {len(xs)})"
    built = lambda script, first: f"array_join(transform(sequence(0, {first} + attempt), i -> {pick(SYLLABLES[script])}), '')"
    given = " ".join(f"WHEN kind = '{k}' THEN IF(attempt < 4, lower(element_at(transform(array(0), i -> {pick(xs)}), 1)), concat({built(k.split('_')[2], -3)}, '{ENDINGS[k[6:]]}'))" for k, xs in GIVEN.items())
    surname = " ".join(f"WHEN kind = 'surname_{k}' THEN {built(k, 2)}" for k in SYLLABLES)
    luhn = "aggregate(transform(split(reverse({}), ''), (c, i) -> IF(i % 2 = 1, cast(c AS int) * 2 - IF(cast(c AS int) > 4, 9, 0), cast(c AS int))), 0, (a, x) -> a + x)"
    fixed = lambda text, keep: text.replace("keep", keep)
    card = fixed(whole, "1")
    checked = f"concat(left({card}, length(canon) - 1), cast(pmod({luhn.format('canon')} - {luhn.format(f'concat(left({card}, length(canon) - 1), {_quote("0")})')}, 10) AS string))"
    # an address keeps its last two labels where they are reserved for examples, else the last; from the 8th draw on it grows
    local = "substr(canon, 1, length(canon) - length(regexp_extract(canon, '(?:[.@]example)?[.][^.]+$', 0)))"
    longer = f"IF(attempt < 8, '', array_join(transform(sequence(8, attempt), i -> char(97 + {v} % 26)), ''))"
    email = f"concat({longer}, {fixed(shaped, '0').replace('split(canon,', f'split({local},')}, regexp_extract(canon, '(?:[.@]example)?[.][^.]+$', 0))"
    return f"""CASE WHEN kind = 'email' THEN {email}
        WHEN kind = 'secret' THEN IF(canon RLIKE '^[0-9a-f]+$', {fixed(hexed, '0')}, {fixed(shaped, '4')})
        WHEN kind = 'iban' THEN {fixed(shaped, '2')}
        WHEN kind = 'ip' THEN {octets}
        WHEN kind = 'ipv6' THEN {fixed(hexed, '0')}
        WHEN kind = 'card' THEN {checked}
        WHEN kind = 'phone' THEN {fixed(whole, "IF(canon LIKE '0%', 1, IF(length(canon) > 10, 2, 0))")}
        WHEN kind = 'ssn' THEN {fixed(whole, '0')}
        {given} {surname} END"""


def surrogates(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct (kind, canon): one to one within a kind, and none a real entity.

    Draws go on until nothing clashes. Only where a kind has about as many entities as its format has values (a
    thousand million social security numbers, say) is that impossible; then draws stop clearing clashes, and it raises.
    """
    drawn = scratch.cut(entities.withColumn("attempt", F.lit(0)).withColumn("seed", F.expr(_seed(key))).withColumn("surrogate", F.expr(_draw())).drop("seed"))
    least, since = None, 0
    while True:
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("kind", "surrogate", F.col("first.canon").alias("first"))
        shared = drawn.join(first, ["kind", "surrogate"]).filter("canon <> first").select("kind", "canon")
        real = drawn.join(entities.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "canon")
        again = scratch.cut(shared.unionByName(real).distinct().withColumn("clash", F.lit(True)))
        n = again.count()
        if not n:
            return drawn.select("kind", "canon", "surrogate")
        least, since = (n, 0) if least is None or n < least else (least, since + 1)
        if since > STALLED:
            raise RuntimeError(f"{n} surrogates clash in every draw: a kind has more entities than its format has values")
        old = drawn
        drawn = drawn.join(again, ["kind", "canon"], "left").withColumn("attempt", F.when(F.col("clash"), F.col("attempt") + 1).otherwise(F.col("attempt"))).withColumn("seed", F.expr(_seed(key)))
        drawn = scratch.cut(drawn.withColumn("surrogate", F.when(F.col("clash"), F.expr(_draw())).otherwise(F.col("surrogate"))).select("kind", "canon", "attempt", "surrogate"))
        scratch.drop(old, again)


def _written(key: str) -> str:
    """A mention m with the surrogates s of its entities, in m's format."""
    # the canonical characters go into the places of the mention's, from the right; what stands left of them stays
    into = lambda place: f"""reverse(aggregate(split(reverse(m), ''), named_struct('out', '', 'k', 1), (a, c) -> IF(c RLIKE '{place}' AND a.k <= length(s[0]),
        named_struct('out', concat(a.out, substr(reverse(s[0]), a.k, 1)), 'k', a.k + 1), named_struct('out', concat(a.out, c), 'k', a.k)), a -> a.out))"""  # noqa: E731
    # case goes from character to character where the lengths agree
    cased = "IF(length(m) = length(s[0]), array_join(zip_with(split(m, ''), split(s[0], ''), (a, b) -> IF(a <> lower(a), upper(b), b)), ''), IF(m = upper(m), upper(s[0]), s[0]))"
    part = "CASE WHEN length(x.c) > 1 AND x.c = upper(x.c) THEN upper(s[a.k]) WHEN x.c RLIKE '^\\\\p{Ll}' THEN s[a.k] ELSE initcap(s[a.k]) END"
    # initials are too few to be kept apart: a keyed letter of the same script for each
    keyed = lambda script: f"upper(substr('{LETTERS[script]}', 1 + cast(conv(substr(sha2(concat({_quote(key)}, c), 256), 1, 4), 16, 10) AS int) % {len(LETTERS[script])}, 1))"
    initials = f"array_join(transform(split(x.c, ''), c -> IF(c = '.', c, CASE {_script('c')} WHEN 'cyrillic' THEN {keyed('cyrillic')} WHEN 'greek' THEN {keyed('greek')} ELSE {keyed('latin')} END)), '')"
    word = f"IF(x.unit, {part}, IF(x.c LIKE '%.', {initials}, x.c))"
    name = f"""concat(split(m, ' ')[0], aggregate(slots, named_struct('out', '', 'k', 0, 'i', -1), (a, x) ->
        named_struct('out', concat(a.out, IF(x.i = a.i, '-', ' '), {word}), 'k', a.k + cast(x.unit AS int), 'i', x.i), a -> a.out))"""
    return f"""CASE WHEN kind = 'person' THEN {name}
        WHEN kind IN ('card', 'phone', 'ssn') THEN {into('[0-9]')}
        WHEN kind = 'iban' THEN {into('[A-Z0-9]')}
        WHEN kind IN ('email', 'secret', 'ipv6') THEN {cased}
        ELSE s[0] END"""


def pseudonymise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None, count_col: str | None = None, kinds_col: str | None = None) -> DataFrame:
    """``df`` with ``text_col`` rewritten; behind its columns ``count_col`` and ``kinds_col``, where names are given, which must not be its own.

    Null and empty texts stay. Ties do not arise: entities are found from left to right. Repeated rows stay
    repeated; rows of a null id are treated as any. Columns of ``df`` may have any name. Texts of any length are
    scanned whole, in one row. An empty table gives an empty one. ``key``: that of the session, if not given.
    """
    spark = df.sparkSession
    scratch, key = Scratch(spark, "pii"), key or session_key(spark)
    names = df.columns
    if clash := {count_col, kinds_col} & set(names):
        raise ValueError(f"columns of the table already: {sorted(clash)}")
    text = F.col(text_col).cast("string")
    # the pattern runs once over all texts; both branches read what it has found
    found = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), text.alias("text"))
    found = scratch.cut(found.select("row", "id", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("m")))
    more = [(c, n) for c, n in ((F.col("n"), count_col), (F.col("kinds"), kinds_col)) if n]
    plain = found.filter(F.coalesce(F.size("m"), F.lit(0)) <= 0).select("row.*", *(F.lit(x).alias(n) for x, n in ((0, count_col), ("", kinds_col)) if n))
    # a row is known by id and a hash of its text
    whole = F.col(f"row.`{text_col}`").cast("string")
    hit = found.filter(F.size("m") > 0).withColumn("k", F.sha2(F.concat_ws("|", F.coalesce(F.col("id"), F.lit("-")), whole), 256))
    hit = scratch.cut(hit.select("k", "row", "m"))
    mentions = hit.select("k", "m").dropDuplicates(["k"]).select("k", F.posexplode("m").alias("at", "m"))
    mentions = mentions.withColumn("kind", F.expr(_kind())).withColumn("slots", F.when(F.col("kind") == "person", F.expr(_slots())))
    mentions = scratch.cut(mentions.select("k", "at", "m", "slots", F.col("kind").alias("mkind"), F.posexplode(F.expr(_units())).alias("nth", "u")).select("k", "at", "m", "slots", "mkind", "nth", "u.kind", "u.canon"))
    made = scratch.cut(surrogates(scratch.cut(mentions.select("kind", "canon").distinct()), scratch, key))
    units = hot_join(mentions, made, ["kind", "canon"], ["k", "at", "nth"])
    per_mention = units.groupBy("k", "at").agg(F.first("m").alias("m"), F.first("slots").alias("slots"), F.first("mkind").alias("kind"), F.array_sort(F.collect_list(F.struct("nth", "surrogate"))).alias("u"))
    per_mention = per_mention.withColumn("s", F.col("u.surrogate")).select("k", "at", "kind", F.expr(_written(key)).alias("w"))
    per_row = per_mention.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("w"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    # what stands between entities, and the new ones
    changed = hit.join(per_row, "k").withColumn("n", F.size("m"))
    between = F.split(whole, ANY, -1)
    new = F.array_join(F.zip_with(between, F.array_append(F.col("w.w"), F.lit("")), lambda a, b: F.concat(a, b)), "")
    return plain.unionByName(changed.select(*((new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names), *(c.alias(n) for c, n in more)))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rewritten text, and how many entities of which kinds it had, of every document.

    Null, empty and very long texts, repeated rows and empty tables: as ``pseudonymise`` has them.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, count_col="n_entities", kinds_col="kinds")
    return out.select("doc_id", "text", F.col("n_entities").cast("long").alias("n_entities"), "kinds")
