"""Personal data against a rewriter that goes text by text and character by character, and texts made to break patterns."""

import hashlib
import random
from collections import Counter

import pytest
import regex

from glyphmill.llm import pii_surrogates as P

KEY = "tests-only"
ANY = regex.compile(P.ANY, regex.V1)
KINDS = {k: regex.compile(f"(?:{p})", regex.V1) for k, p in P.PATTERNS.items()}


def kind_of(m):
    return next((k for k, p in KINDS.items() if k != "person" and p.fullmatch(m)), "person")


def script_of(x):
    return "cyrillic" if regex.search(r"\p{IsCyrillic}", x) else "greek" if regex.search(r"\p{IsGreek}", x) else "latin"


def digits(m):
    return regex.sub("[^0-9]", "", m)


def name_parts(m):
    """(token, part, whether an entity) behind the form of address."""
    out = []
    for i, t in enumerate(m.split(" ")[1:]):
        own = not (regex.fullmatch(r"(?:\p{Lu}\.)+", t) or regex.fullmatch(r"\p{Ll}+", t))
        out += [(i, c, own) for c in t.split("-")]
    return out


def entities(m):
    k = kind_of(m)
    if k == "person":
        title = m.split(" ")[0].removesuffix(".")
        named = [(i, c) for i, c, own in name_parts(m) if own]
        last = max(i for i, _ in named)
        g = "m" if title in P.MALE else "f" if title in P.FEMALE else "f" if regex.search("[aAeEáéаАяЯиИαΑάηΗή]$", named[0][1]) else "m"
        return [(("surname_" if i == last else f"given_{g}_") + script_of(c), c.lower()) for i, c in named]
    if k == "phone":
        d = digits(m)
        return [(k, d[1:] if m.startswith("+1") and len(d) == 11 else d)]
    if k in ("ssn", "card"):
        return [(k, digits(m))]
    return [(k, {"email": m.lower(), "ipv6": m.lower(), "iban": m.replace(" ", ""), "ip": m, "secret": m.lower() if regex.fullmatch("[0-9a-fA-F]+", m) else m}[k])]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - (9 if int(c) > 4 else 0) for i, c in enumerate(reversed(d)))


def draw(kind, canon, attempt):
    seed = sha("|".join([KEY, kind, canon, str(attempt), KEY]))

    def v(i):
        return int(sha(f"{seed}|{i // 16}")[i % 16 * 4 : i % 16 * 4 + 4], 16)

    def shaped(text, keep):
        out = ""
        for i, c in enumerate(text):
            if i < keep:
                out += c
            elif c in "0123456789":
                out += str(v(i) % 10)
            elif "A" <= c <= "Z":
                out += chr(65 + v(i) % 26)
            elif regex.fullmatch("[а-яё]", c):
                out += P.LETTERS["cyrillic"][v(i) % len(P.LETTERS["cyrillic"])]
            elif regex.fullmatch("[α-ω]", c):
                out += P.LETTERS["greek"][v(i) % len(P.LETTERS["greek"])]
            else:
                out += chr(97 + v(i) % 26) if regex.fullmatch(r"\p{L}", c) else c
        return out

    def whole(keep):
        return "".join(c if i < keep else str(2 + v(i) % 8 if i == keep and kind == "phone" else v(i) % 10) for i, c in enumerate(canon))

    def built(script, n):
        xs = P.SYLLABLES[script]
        return "".join(xs[v(i) % len(xs)] for i in range(n))

    if kind == "email":
        end = regex.search(r"(?:[.@]example)?[.][^.]+$", canon)[0]
        longer = "".join(chr(97 + v(i) % 26) for i in range(8, attempt + 1))
        return longer + shaped(canon[: len(canon) - len(end)], 0) + end
    if kind == "secret" and not regex.fullmatch("[0-9a-f]+", canon):
        return shaped(canon, 4)
    if kind in ("secret", "ipv6"):
        return "".join(c if c == ":" else f"{v(i) % 16:x}" for i, c in enumerate(canon))
    if kind == "iban":
        return shaped(canon, 2)
    if kind == "ip":
        return ".".join(str(1 + v(i) % 254) for i in range(4))
    if kind == "card":
        head = whole(1)[:-1]
        return head + str((luhn(canon) - luhn(head + "0")) % 10)
    if kind == "phone":
        return whole(1 if canon.startswith("0") else 2 if len(canon) > 10 else 0)
    if kind == "ssn":
        return whole(0)
    if kind.startswith("surname_"):
        return built(kind[8:], 3 + attempt)
    names = P.GIVEN[kind]
    return names[v(0) % len(names)].lower() if attempt < 4 else built(kind.split("_")[2], attempt - 2) + P.ENDINGS[kind[6:]]


def all_surrogates(found):
    attempt = dict.fromkeys(found, 0)
    while True:
        made = {e: draw(*e, n) for e, n in attempt.items()}
        shared = {}
        for e, s in made.items():
            shared.setdefault((e[0], s), []).append((attempt[e], e[1], e))
        again = {e for xs in shared.values() for *_, e in sorted(xs)[1:]} | {e for e, s in made.items() if (e[0], s) in attempt}
        if not again:
            return made
        for e in again:
            attempt[e] += 1


def written(m, made):
    k, s = kind_of(m), [made[e] for e in entities(m)]
    if k == "person":
        out, at, before = m.split(" ")[0], 0, -1
        for i, c, own in name_parts(m):
            out += "-" if i == before else " "
            before = i
            if own:
                x, at = s[at], at + 1
                out += x.upper() if len(c) > 1 and c == c.upper() else x if regex.match(r"\p{Ll}", c) else x[0].upper() + x[1:]
            elif c.endswith("."):
                out += "".join(x if x == "." else (letters := P.LETTERS[script_of(x)])[int(sha(KEY + x)[:4], 16) % len(letters)].upper() for x in c)
            else:
                out += c
        return out
    x = s[0]
    if k in ("card", "phone", "ssn", "iban"):
        place, out, left = "[0-9]" if k != "iban" else "[A-Z0-9]", "", list(x)
        for c in reversed(m):
            out += left.pop() if left and regex.fullmatch(place, c) else c
        return out[::-1]
    if k == "ip":
        return x
    if len(m) == len(x):
        return "".join(b.upper() if a != a.lower() else b for a, b in zip(m, x, strict=True))
    return x.upper() if m == m.upper() else x


def random_texts(n):
    rng = random.Random(12)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(1, 7)))
    cap = lambda: rng.choice([word().capitalize(), word().upper(), "O'" + word().capitalize(), word().capitalize() + "-" + word().capitalize(), "Иванов", "Νίκος", "Łukasz"])
    makers = [
        lambda: word(), lambda: word() + rng.choice([".", ",", "\n", ""]), lambda: d(rng.randint(1, 20)), lambda: f"{rng.choice([word(), cap()])}.{word()}@{rng.choice([word(), cap()])}.{rng.choice(['com', 'example.org', 'Co.UK', 'x'])}",
        lambda: f"{rng.choice([*P.MALE, *P.FEMALE, *P.EITHER])}{rng.choice(['.', ''])} {rng.choice(['', 'J. ', 'J.R. ', 'van der ', 'de '])}{cap()}{rng.choice(['', ' ' + cap(), ' K. ' + cap(), ' de la ' + cap()])}",
        lambda: f"+{rng.choice(['1', '33', '49'])} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"030 {d(7)}", lambda: f"6{d(2)} {d(3)} {d(3)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: ".".join(str(rng.randint(0, 270)) for _ in range(rng.randint(3, 5))), lambda: ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8)), lambda: f"2001:DB8::{rng.randint(0, 65535):x}",
        lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: "DE" + d(20), lambda: "GB82 WEST 1234 5698 7654 32", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(30, 40))), lambda: "AKIA" + "".join(rng.choice("ABCDEFGH1234") for _ in range(16)), lambda: "sk-" + word() * 8, lambda: rng.choice("@:.+-'([")
    ]
    return ["".join(rng.choice(makers)() + rng.choice([" ", " ", "  ", "\n", "", "-", ": "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_against_a_rewriter_by_character(spark):
    texts = random_texts(2000)
    found = {t: [m.group() for m in ANY.finditer(t)] for t in texts}
    made = all_surrogates({e for ms in found.values() for m in ms for e in entities(m)})
    got = {r.doc_id: r for r in P.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key=KEY, count_col="n", kinds_col="kinds").collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for m in ANY.finditer(t):
            out += t[at : m.start()] + written(m.group(), made)
            at = m.end()
        assert (got[i].text, got[i].n, got[i].kinds) == (out + t[at:], len(found[t]), ",".join(sorted({kind_of(m) for m in found[t]})))
    assert len(Counter(k for ms in found.values() for k in map(kind_of, ms))) == len(P.PATTERNS)


@pytest.mark.parametrize(
    "text,gone",
    [
        ("Mr. Jean-Luc O'Brien", ["Jean", "Luc", "O'", "Brien"]), ("Mr JOHN SMITH", ["JOHN", "SMITH"]), ("Dr. Νίκος Παπαδόπουλος", ["Νίκος", "Παπ"]), ("Mr. Vincent van Gogh", ["Vincent", "Gogh"]),
        ("Dr. J. R. Smith", ["Smith", "J."]), ("06 12 34 56 78", ["12 34"]), ("+33 6 12 34 56 78", ["12 34"]), ("2001:db8::1", ["2001"]), ("Anna.Lee@Corp.COM", ["Anna", "Corp"]), ("+49 30 1234567", ["1234567"]),
    ],
)
def test_nothing_stays_in_clear(spark, text, gone):
    out = P.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), key=KEY).first().text
    assert not [x for x in gone if x in out] and regex.findall(r"\p{IsGreek}", text) == [] or regex.search(r"\p{IsGreek}{4}", out)
    if "@" in text:
        assert [c.isupper() for c in out] == [c.isupper() for c in text]


def test_long_texts_made_to_break_patterns(spark):
    n = 1 << 20
    texts = ["x@" + "ab." * (n // 3) + "1", "a" * n + "@b.c", "x@" + "a-" * (n // 2), "0" * n + "z", "Mr. " + "A-" * (n // 2) + "b", "AB12" + " ABCD" * (n // 5), "a:" * (n // 2), "1.2." * (n // 4), "Mr. " + "O'A" * (n // 3), "\U00010400a" * (n // 4) + "@b.c", "(" * n, "+1" * (n // 2), "sk-" + "a" * n, "1-" * (n // 2), "@" * n]
    got = P.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), key=KEY)
    out = {r.doc_id: r.text for r in got.collect()}
    assert len(out) == len(texts) and out[0] != texts[0] and "ab." * 9 not in out[0] and out[3] == texts[3]


def test_columns_of_any_name_and_the_session_key(spark):
    df = spark.createDataFrame([(1, "ask a.b@c.org", "x", "y", "z"), (1, "ask a.b@c.org", "x", "y", "z")], "doc_id long, text string, __k string, row string, m string")
    got = P.pseudonymise(df)
    assert got.columns == df.columns and [tuple(r)[2:] for r in got.collect()] == [("x", "y", "z")] * 2
    assert got.select("text").distinct().collect() == P.pseudonymise(df).select("text").distinct().collect() != df.select("text").distinct().collect()
    assert spark.conf.get(P.KEY_SETTING)
    with pytest.raises(ValueError):
        P.pseudonymise(df, count_col="m")
