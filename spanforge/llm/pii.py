"""Personal data replaced by keyed surrogates (operator 10).

*Detection.*  Mail addresses, IPv4 and IPv6 addresses, phone numbers, card, bank account and
social security numbers, secret tokens, and names that a title or a phrase of
introduction announces; a name found in a text is also found where the text repeats it.

*Surrogates.*  An entity's canonical form (letters in lower case, digits alone) goes through a
keyed Feistel network over its own digits and letters, a bijection among the strings of one
shape; so entities of one type and shape can't collide, and all mentions of one entity get the
same surrogate, written in the mention's own format: separators, case, length, country code,
the check digits of valid cards and accounts, a token's prefix, and octets within 0-255.  Names
get a given name of the same gender and script and a family name built from syllables of the
same script; with every further drawing they have one syllable more, so forms never run out.

*Collisions.*  All distinct entities of the corpus and their surrogates are compared by joins.
Entities whose surrogate is itself an entity of the corpus, or is shared with an entity that
comes before, are drawn again with the next number until none is left.  Where the corpus holds
over a quarter of all strings of a shape (short phone numbers), its entities keep the first
drawing, which permutes them: they stay distinct, but may equal other entities.  Exceptions are
sent to the tasks while they are fewer than ``broadcast_rows``, else joined to the texts that
need them.

*Key.*  Without a key each call draws one and forgets it, so that nobody can turn the surrogates
back; with a key all calls give the same surrogates.

Defined results: a null text stays null, an empty one empty; repeated rows are each replaced
alike; ids aren't used; texts without entities are unchanged; an empty table gives an empty
result; all further columns are returned by ``replaced``.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frame import Framed, table
from ._scratch import cut

# Given names by gender and script: fixed values, most to least common.
GIVEN = {
    ("f", "latin"): "mary anna maria laura sophie julia emma clara marie elena lucia nina".split(),
    ("m", "latin"): "john thomas peter paul martin david lucas simon felix hugo oscar victor".split(),
    ("f", "cyrillic"): "анна мария елена ольга ирина наталья светлана татьяна".split(),
    ("m", "cyrillic"): "иван петр сергей андрей дмитрий алексей николай виктор".split(),
    ("f", "greek"): "μαρία ελένη άννα σοφία κατερίνα δήμητρα".split(),
    ("m", "greek"): "γιώργος νίκος δημήτρης κώστας γιάννης πέτρος".split(),
}
_SYLLABLES = {
    "latin": "ba ben cor dal der en fal gar hol in kel lan mar nor ol per ran sel tor ul ver wen".split(),
    "cyrillic": "бе вор дан ков лен мар нов пет рос сав тол чер".split(),
    "greek": "βα γε δη κα λι μα νο πα ρου στα τσι χρι".split(),
}
_ENDINGS = {("f", "latin"): ("a", "ia", "ina"), ("m", "latin"): ("o", "us", "in"), ("f", "cyrillic"): ("а", "ия", "ина"),
            ("m", "cyrillic"): ("ан", "ий", "ор"), ("f", "greek"): ("α", "ία", "η"), ("m", "greek"): ("οσ", "ησ", "ασ")}
# Titles with the gender that they tell ("" if none), and phrases that announce a name.
TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "dr": "", "prof": "", "herr": "m", "frau": "f", "monsieur": "m", "mme": "f", "madame": "f", "señor": "m", "señora": "f", "г-н": "m", "г-жа": "f", "κ": ""}
_INTRO = r"(?:my name is|signed by|je m'appelle|ich heiße|me llamo|меня зовут|με λένε)"
_WORD = r"[^\W\d_a-zà-öø-ÿа-яёα-ωά-ώ][^\W\d_]+"

_ENTITY = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]))"
    r"|(?P<token>(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{30,}|(?:sk|pk|rk)[-_](?=[\w-]*\d)[\w-]{16,}|xox[abprs]-(?=[\w-]*\d)[\w-]{10,}|AIza[\w-]{35}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![\w.])\d{4}(?P<dash>[ -]?)\d{4}(?P=dash)\d{4}(?P=dash)\d{1,7}(?!\d))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d))"
    r"|(?P<call>(?<![\w.])(?:\+[1-9]\d{6,14}|(?:\+|00)[1-9]\d{0,2}(?:[ ./()-]{1,2}\d{1,8})?(?:[ ./()-]{1,2}\d{2,8}){1,5}|0[1-9]\d{0,3}(?P<sep>[ ./-])\d{2,8}(?:(?P=sep)\d{2,8}){0,4})(?!\d))"
    r"|(?P<ssn>(?<![\w.-])\d{3}(?P<gap>[ -])\d{2}(?P=gap)\d{4}(?![\w-]|\.\d))"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:(?=[a-f0-9]*\d)(?=[a-f0-9]*[a-f])[a-f0-9]{24,}|(?=[A-F0-9]*\d)(?=[A-F0-9]*[A-F])[A-F0-9]{24,})(?![A-Za-z0-9]))",
)
_NAME = re.compile(rf"(?P<cue>(?<!\w)(?:{'|'.join(map(re.escape, TITLES))})\b\.?|{_INTRO})\s+(?P<name>(?-i:{_WORD})(?:\s+(?-i:{_WORD}))?)", re.IGNORECASE)


_DIGITS = ("card", "phone", "ssn")
_KINDS = ("email", "ip", "ipv6", "token", "iban", "card", "phone", "call", "ssn", "secret")
_TOKEN_HEAD = re.compile(r"(?:AKIA|ASIA|gh[opsur]_|(?:sk|pk|rk)[-_](?:(?:live|test|proj|ant)[-_])?|xox[abprs]-|AIza|eyJ)")
_MARKS = re.compile(r"[\d@]")


def _folded(text: str) -> str:
    """Letters that a pattern takes as equal, whatever their case, made equal."""
    return text.casefold().replace("i\u0307", "i").replace("ı", "i")


_GENDER = {_folded(n): k for k, names in GIVEN.items() for n in names}


_TITLES = {_folded(k): v for k, v in TITLES.items()}
_CUES = tuple(_folded(x) for x in (*TITLES, *_INTRO[3:-1].split("|")))


def _announced(text: str) -> bool:
    """False only if no cue of a name is a part of the text, in whatever place and case."""
    low = _folded(text)
    return any(c in low for c in _CUES)


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


Entity = tuple[int, int, str, str]


def entities(text: str) -> list[Entity]:
    """(start, end, type, canonical form) of the text's entities, in order and without overlap."""
    found: list[Entity] = []
    if _MARKS.search(text):
        at = 0
        while m := _ENTITY.search(text, at):
            at = m.start() + 1  # of what is passed over, later parts may be an entity
            s, digits = m.group(), re.sub(r"\D", "", m.group())
            kind = next(k for k in _KINDS if m.group(k) is not None)
            if kind == "card" and len(digits) < 13:
                continue
            if kind == "iban" and _mod97(s.replace(" ", "")) != 1:
                continue
            if kind == "call":  # a phone number in another form; dates have fewer digits
                if not (9 - (s[0] == "+") * 2 <= len(digits) <= 17):
                    continue
                kind = "phone"
            at = m.end()
            canon = digits if kind in _DIGITS else s if kind == "token" else s.replace(" ", "") if kind == "iban" else s.lower()
            found.append((m.start(), m.end(), kind, canon))
    names: dict[str, str] = {}
    written_as: set[str] = set()
    for m in _NAME.finditer(text) if _announced(text) else ():
        cue = _folded(m.group("cue")).rstrip(".")
        parts = [_folded(x) for x in m.group("name").split()]
        given = parts[0] if len(parts) > 1 or parts[0] in _GENDER else None
        gender = _TITLES.get(cue, "") or (_GENDER[given][0] if given in _GENDER else "")
        if given:
            names.setdefault(given, f"given:{gender}:{given}")
        if len(parts) > 1 or not given:
            names.setdefault(parts[-1], f"family::{parts[-1]}")
        written_as |= set(m.group("name").split())
    if names:
        taken = [False] * (len(text) + 1)
        for a, b, _, _ in found:
            taken[a:b] = [True] * (b - a)
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(written_as, key=lambda x: (-len(x), x)))) + r")(?!\w)", re.IGNORECASE)
        for m in again.finditer(text):
            canon = names.get(_folded(m.group()))
            if canon and m.group()[0].isupper() and not taken[m.start()]:
                found.append((m.start(), m.end(), "name", canon))
    return sorted(found)


def _draw(key: bytes, *what: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest()[:12], "big")


def _feistel(key: bytes, kind: str, attempt: int, values: list[int], sizes: list[int]) -> list[int]:
    """A keyed bijection of mixed-radix numbers: halves are shifted by functions of each other."""
    v, half = list(values), len(values) // 2
    a, b = range(half), range(half, len(v))
    for r in range(6):
        own, other = (a, b) if r % 2 else (b, a)
        seed = _draw(key, kind, attempt, r, tuple(v[i] for i in other), tuple(sizes))
        for i in own:
            v[i] = (v[i] + seed) % sizes[i]
            seed = seed // sizes[i] + 0x9E3779B9 * (i + 1)
    return v


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(reversed(digits))) * 9 % 10


def _mod97(account: str) -> int:
    """The remainder of a bank account number (country, check digits, rest) that should be 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def _shuffled(key: bytes, kind: str, attempt: int, text: str, alphabets: tuple[str, ...]) -> str:
    """Each character of an alphabet becomes one of the same alphabet, the others stay."""
    of = {c: a for a in alphabets for c in a}
    at = [i for i, c in enumerate(text) if c in of]
    new = _feistel(key, kind, attempt, [of[text[i]].index(text[i]) for i in at], [len(of[text[i]]) for i in at])
    out = list(text)
    for i, x in zip(at, new, strict=True):
        out[i] = of[text[i]][x]
    return "".join(out)


_DIGIT, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate."""
    if kind == "ip":
        return ".".join(map(str, _feistel(key, kind, attempt, list(map(int, canon.split("."))), [256] * 4)))
    if kind in _DIGITS:
        d = list(map(int, canon))
        if kind == "card" and _luhn(d[:-1]) == d[-1]:
            head = _feistel(key, "card+", attempt, d[:-1], [10] * (len(d) - 1))
            return "".join(map(str, [*head, _luhn(head)]))
        keep = 1 if kind == "phone" else 0
        return "".join(map(str, d[:keep] + _feistel(key, kind, attempt, d[keep:], [10] * (len(d) - keep))))
    if kind == "name":
        part, gender, word = canon.split(":", 2)
        script = _script(word)
        if part == "given":
            gender_of = gender or ("f", "m")[_draw(key, "gender", word) % 2]
            pool = [_folded(x) for x in GIVEN[(gender_of, script)]]
            if not attempt:
                at = pool.index(word) if word in pool else _draw(key, "given", word) % len(pool)
                return f"given:{gender}:{pool[(at + 1 + _draw(key, 'turn', gender, script) % (len(pool) - 1)) % len(pool)]}"
            ends = _ENDINGS[(gender_of, script)]
            return f"given:{gender}:{_syllables(key, 'given', word, script, attempt, 1 + attempt)}{ends[_draw(key, 'ending', word, attempt) % len(ends)]}"
        return f"family::{_syllables(key, 'family', word, script, attempt, 2 + len(word) // 3 + attempt)}"
    if kind == "iban":
        rest = _shuffled(key, "iban" + canon[:2], attempt, canon[4:], (_DIGIT, _UPPER))
        return f"{canon[:2]}{98 - _mod97(canon[:2] + '00' + rest):02d}{rest}"
    if kind == "token":
        head = _TOKEN_HEAD.match(canon).end()
        return canon[:head] + _shuffled(key, canon[:head], attempt, canon[head:], (_DIGIT, _LOWER, _UPPER))
    if kind in ("secret", "ipv6"):
        return _shuffled(key, kind, attempt, canon, (_HEX,))
    tail = canon.rfind(".")  # of a mail address the top-level domain stays
    return _shuffled(key, kind, attempt, canon[:tail], (_DIGIT, _LOWER)) + canon[tail:]


def _syllables(key: bytes, part: str, word: str, script: str, attempt: int, n: int) -> str:
    x, s, out = _draw(key, part, word, attempt), _SYLLABLES[script], ""
    for _ in range(n):
        out += s[x % len(s)]
        x //= len(s)
    return out


def shape(kind: str, canon: str) -> tuple[str, float]:
    """What surrogates of an entity share with it, and the decimal logarithm of how many there are."""
    if kind == "ip":
        return "", math.log10(256) * 4
    if kind in _DIGITS:
        return str(len(canon)), float(len(canon) - (kind == "phone"))
    if kind == "email":
        head, _, tail = canon.rpartition(".")
        letters, digits = sum(c in _LOWER for c in head), sum(c in _DIGIT for c in head)
        return "".join("a" if c in _LOWER else "0" if c in _DIGIT else c for c in head) + "." + tail, letters * math.log10(26) + digits
    if kind == "ipv6":
        return re.sub(r"\w", "f", canon), sum(c in _HEX for c in canon) * math.log10(16)
    return "", 99.0  # names, tokens and accounts have more forms than any corpus


def written(kind: str, canon: str, mention: str) -> str:
    """A surrogate in the format of the mention that it replaces."""
    if kind == "ip":
        return canon
    if kind in _DIGITS:
        digits = iter(canon)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "name":
        word = re.sub("σ$", "ς", canon.split(":", 2)[2])
        return word.upper() if mention.isupper() and len(mention) > 1 else word.capitalize()
    if kind == "token":
        return canon
    if kind == "iban":
        rest = iter(canon)
        return "".join(c if c == " " else next(rest) for c in mention)
    return "".join(c.upper() if m.isupper() else c for c, m in zip(canon, mention, strict=True))


def _entity_udf():
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("canon", T.StringType())]))

    @F.arrow_udf(kind)
    def find(texts: pa.Array) -> pa.Array:
        rows = [sorted({(k, c) for _, _, k, c in entities(t.as_py() or "")}) for t in texts]
        return pa.array([[{"kind": k, "canon": c} for k, c in r] for r in rows], pa.list_(pa.struct([("kind", pa.string()), ("canon", pa.string())])))

    return find


def _surrogate_udf(key: bytes):
    @F.arrow_udf(T.StringType())
    def make(kind: pa.Array, canon: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *x) for x in zip(kind.to_pylist(), canon.to_pylist(), attempt.to_pylist(), strict=True)], pa.string())

    return make


def _shape_udf():
    kind = T.StructType([T.StructField("shape", T.StringType()), T.StructField("size", T.DoubleType())])

    @F.arrow_udf(kind)
    def find(kinds: pa.Array, canon: pa.Array) -> pa.Array:
        got = [shape(*x) for x in zip(kinds.to_pylist(), canon.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], kind.names)

    return find


def exceptions(found: DataFrame, key: bytes, most: int = 60) -> DataFrame:
    """(kind, canon, attempt) of the distinct entities whose first surrogate collides.

    Surrogates must differ from each other and from all entities of the corpus; entities of
    shapes of which the corpus holds over a quarter keep their first surrogates.  After ``most``
    drawings, which chance does not bring about, it raises.
    """
    make = _surrogate_udf(key)
    shaped = cut(found.select("kind", "canon").withColumn("s", _shape_udf()("kind", "canon")).select("kind", "canon", "s.*"))
    full = shaped.groupBy("kind", "shape").agg(F.count("*").alias("n"), F.max("size").alias("size")).where(F.log10("n") > F.col("size") + math.log10(0.25))
    free = shaped.join(full, ["kind", "shape"], "left_anti").select("kind", "canon")
    state = cut(free.select("kind", "canon", F.lit(0).alias("attempt"), make("kind", "canon", F.lit(0)).alias("new")))
    for _ in range(most):
        real = state.select("kind", F.col("canon").alias("new"))
        taken = state.join(real, ["kind", "new"], "left_semi").select("kind", "canon")
        shared = state.groupBy("kind", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n")).where("n > 1")
        later = state.join(shared, ["kind", "new"]).where("canon <> first").select("kind", "canon")
        again = cut(taken.union(later).distinct().withColumn("bad", F.lit(True)))
        if again.isEmpty():
            return state.where("attempt > 0").select("kind", "canon", "attempt")
        state = cut(state.join(again, ["kind", "canon"], "left").select(
            "kind", "canon", (F.col("attempt") + F.when(F.col("bad"), 1).otherwise(0)).alias("attempt"))
            .withColumn("new", make("kind", "canon", "attempt")))
    raise RuntimeError(f"surrogates still collide after {most} drawings")


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def _replace(text: str | None, key: bytes, drawn: dict[tuple[str, str], int], known: dict) -> tuple[str | None, list[str]]:
    if text is None:
        return None, []
    out, at, kinds = [], 0, []
    for a, b, kind, canon in entities(text):
        if a < at:
            continue
        if (new := known.get((kind, canon))) is None:
            new = surrogate(key, kind, canon, drawn.get((kind, canon), 0))
        out += [text[at:a], written(kind, new, text[a:b])]
        at = b
        kinds.append(kind)
    return "".join([*out, text[at:]]) if kinds else text, kinds


def _replace_udf(key: bytes, drawn: dict[tuple[str, str], int]):
    @F.arrow_udf(_RESULT)
    def replace(texts: pa.Array) -> pa.Array:
        got = [_replace(t.as_py(), key, drawn, {}) for t in texts]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([len(g[1]) for g in got], pa.int64()), pa.array([sorted(set(g[1])) for g in got], pa.list_(pa.string()))], _RESULT.names)

    return replace


def _replace_joined_udf(key: bytes):
    @F.arrow_udf(_RESULT)
    def replace(texts: pa.Array, own: pa.Array) -> pa.Array:
        got = [_replace(t.as_py(), key, {(x["kind"], x["canon"]): x["attempt"] for x in o.as_py() or ()}, {}) for t, o in zip(texts, own, strict=True)]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([len(g[1]) for g in got], pa.int64()), pa.array([sorted(set(g[1])) for g in got], pa.list_(pa.string()))], _RESULT.names)

    return replace


def _with_result(docs: DataFrame, text: str, key: bytes, broadcast_rows: int) -> DataFrame:
    """docs with the column _r: new text, number of entities and their kinds."""
    held = docs.select(F.col(text).alias("t")).where("t is not null")
    found = held.select(F.explode(_entity_udf()("t")).alias("e")).select("e.kind", "e.canon").distinct()
    odd = exceptions(found, key)
    some = odd.limit(broadcast_rows + 1).collect()
    if len(some) <= broadcast_rows:
        return docs.withColumn("_r", _replace_udf(key, {(r.kind, r.canon): r.attempt for r in some})(text))
    # too many to send: each text that needs some gets its own, by the text's hash
    of = (held.select(F.sha2("t", 256).alias("_k"), F.explode(_entity_udf()("t")).alias("e")).select("_k", "e.kind", "e.canon").distinct()
          .join(odd, ["kind", "canon"]).groupBy("_k").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("_own")))
    return (docs.withColumn("_k", F.sha2(F.col(text), 256)).join(of, "_k", "left")
            .withColumn("_r", _replace_joined_udf(key)(F.col(text), F.col("_own"))).drop("_k", "_own"))


def replaced(docs: DataFrame, key: bytes | None = None, broadcast_rows: int = 100_000, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, and surrogates in place of the entities of the text."""
    f, key = Framed(docs, text_col), key or secrets.token_bytes(32)
    return f.keep(lambda d: _with_result(d, f.columns[0], key, broadcast_rows), **{text_col: F.col("_r.text")})


def surrogates(docs: DataFrame, key: bytes | None = None, broadcast_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_entities, kinds): the new text, how many entities it had and of which kinds."""
    f, key = Framed(docs, id_col, text_col), key or secrets.token_bytes(32)
    return _with_result(f.df, f.columns[1], key, broadcast_rows).select(
        F.col(f.columns[0]).alias(id_col), F.col("_r.text").alias(text_col), "_r.n_entities", F.array_join("_r.kinds", ",").alias("kinds"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates(table(spark, sf_dir, "documents"))


__all__ = ["entities", "exceptions", "op10_pii_surrogates", "replaced", "surrogate", "surrogates", "written"]
