"""PII surrogates, with DataFrame functions only.

Detected entities are replaced by keyed surrogates of their own kind and format. A surrogate is made by a
Feistel network over the entity's characters: each half is shifted, in turn, by a stream drawn from the
key, the kind and the other half, and a shift stays within the character's own alphabet (digits, lower or
upper case of its script, octets, hexadecimal digits). So it is a bijection on strings of one shape: equal
entities get equal surrogates wherever they occur (coreference), different ones never the same
(distinctness), and no table of the corpus' entities has to be gathered, shuffled or sent. Known given
names are permuted by the key among the names of their gender; titles stay. Each other word of a name has a surrogate
of its own, made from key and word alone, and surnames of persons found in a document are replaced in it where they stand
alone, too. A card keeps its issuer digit
and its check sum, a phone number its country code, an e-mail address its top-level domain.

Collisions are checked all the same: `n_collisions` counts a document's surrogates that stand for two
originals or equal another original of the document, and `collisions()` looks across documents.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
MALE = "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Stephen Andrew Joshua Kenneth Kevin Brian George Edward Heinrich Wolfgang Matthias Sebastian Antoine Guillaume Fernando Alejandro Santiago".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Margaret Sandra Ashley Kimberly Emily Michelle Amanda Melissa Deborah Stephanie Rebecca Katharina Hannelore Brigitte Charlotte Isabelle Guadalupe Francisca Alejandra Veronica".split()
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra"
_SECRET = "password|passwd|passwort|secret|token|api_key|apikey|access_key"

#: Kind -> pattern, in the order in which they are tried. All start where no letter or digit stands before. None repeats a
#: group without bound, which would take a stack frame for each turn; parts of an address have the lengths that mail allows.
PATTERNS = {
    "email": r"[\p{L}\d_][\p{L}\d._%+-]{0,63}@[\p{L}\d-][\p{L}\d.-]{0,253}\.\p{L}{2,63}",
    "hex": r"[0-9a-fA-F]{32,}(?![\p{L}\d])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "card": r"\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "aws": r"A[KS]IA[A-Z0-9]{16}(?![A-Z0-9])",
    "secret": rf"(?<=(?i:{_SECRET})[\"']?[ \t]{{0,2}}[=:][ \t]{{0,2}}[\"']?)[A-Za-z0-9+/_.~-]{{6,}}",
    "person": rf"(?:(?:(?:{_TITLES})\.? ){{1,3}}\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?|(?:{'|'.join(MALE + FEMALE)}) \p{{Lu}}[\p{{L}}'-]+)",
}
_ANY = r"(?<![\p{L}\d])(?=[\p{L}\d_+(/])(?:" + "|".join(PATTERNS.values())
ANY = _ANY + ")"
_TITLE = rf"(?:(?:{_TITLES})\.? ){{0,3}}"
_ENDING = r"('s|['-]+)$"  #: after a surname, not part of it

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHABETS = [_DIGITS, _LOWER, _UPPER, "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_HEX = ["0123456789abcdef"]
_HEX_UPPER = ["0123456789ABCDEF"]
_HEX_MIXED = [_DIGITS, "abcdef", "ABCDEF"]  #: disjoint, so that it stays a bijection and the result mixed
_OCTETS = ["".join(chr(0x100 + i) for i in range(256))]  #: octets are written so while they are shifted


def _given(key: str) -> dict[str, str]:
    """Each gender's names, permuted by the key; no name stays itself."""
    out = {}
    for names in (MALE, FEMALE):
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shift(s: Column, seed: Column, alphabets: Column) -> Column:
    """Each character moved within its alphabet by a byte of the seed's digest; others stay."""

    def move(digest, c, i):
        step = F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        own = F.filter(alphabets, lambda a: F.instr(a, c) > 0)
        return F.when(F.size(own) > 0, _bind(F.element_at(own, F.lit(1)), lambda a: F.substr(a, (F.instr(a, c) - 1 + step) % F.length(a) + 1, F.lit(1)))).otherwise(c)

    return _bind(F.sha2(seed.cast("binary"), 256), lambda digest: F.array_join(F.transform(_chars(s), lambda c, i: move(digest, c, i)), ""))


def _luhn(digits: Column) -> Column:
    """Sum of the first 15 digits, every other one doubled, modulo 10."""
    values = F.transform(_chars(F.substr(digits, F.lit(1), F.lit(15))), lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _kind(e: Column) -> Column:
    tests = reduce(lambda a, kv: a.when(e.rlike("^(?:" + kv[1] + ")$"), kv[0]) if a is not None else F.when(e.rlike("^(?:" + kv[1] + ")$"), kv[0]), [(k, v) for k, v in PATTERNS.items() if k != "secret"], None)
    return tests.otherwise("secret")


def surnames(entities: Column) -> Column:
    """The last words of the persons among the entities, without an ending; those that begin with others first."""
    persons = F.filter(entities, lambda e: e.rlike("^(?:" + PATTERNS["person"] + ")$"))
    last = F.transform(persons, lambda e: F.regexp_replace(F.substring_index(e, " ", -1), _ENDING, ""))
    return F.sort_array(F.array_distinct(F.filter(last, lambda w: (F.length(w) > 1) & ~w.rlike(rf"^(?:{_TITLES})$"))), asc=False)


def surrogates(entities: Column, key: str, known: Column) -> Column:
    """Array of entities -> array of structs (kind, original, surrogate), in the same order; known surnames are persons."""
    names = F.create_map(*(F.lit(x) for kv in _given(key).items() for x in kv))

    def parts(e: Column, kind: Column) -> Column:
        """head and tail stay; body is shifted, and so is given, a person's given name that isn't known."""
        digits = F.regexp_replace(e, r"\D", "")
        before = F.when(kind == "phone", F.regexp_extract(e, r"^(\+\d{1,3})", 1)).when(kind == "card", F.substr(e, F.lit(1), F.lit(1))).when(kind == "iban", F.substr(e, F.lit(1), F.lit(2))).when(kind == "aws", F.substr(e, F.lit(1), F.lit(4)))
        before = before.when(kind == "person", F.regexp_extract(e, rf"^({_TITLE}(?:(?:{'|'.join(MALE + FEMALE)}) )?)", 1)).otherwise("")
        after = F.when(kind == "email", F.regexp_extract(e, r"(\.\p{L}{2,})$", 1)).when(kind == "card", F.substr(e, F.length(e), F.lit(1))).when(kind == "person", F.regexp_extract(e, _ENDING, 1)).otherwise("")
        octets = F.array_join(F.transform(F.split(e, r"\."), lambda o: F.substr(F.lit(_OCTETS[0]), o.cast("int") + 1, F.lit(1))), "")
        between = lambda p: F.substr(e, F.length(p["head"]) + 1, F.length(e) - F.length(p["head"]) - F.length(p["tail"]))
        given = lambda p: F.when(kind == "person", F.regexp_extract(between(p), r"^(.*) ", 1)).otherwise("")
        body = lambda p: F.when(kind == "ip", octets).when(kind == "person", F.substring_index(between(p), " ", -1)).otherwise(between(p))
        return _bind(F.struct(before.alias("head"), after.alias("tail")), lambda p: F.struct(p["head"].alias("head"), given(p).alias("given"), body(p).alias("body"), p["tail"].alias("tail"), digits.alias("digits")))

    def half(s: Column) -> Column:
        return F.floor(F.length(s) / 2).cast("int")

    def halves(s: Column, left: str, right: str) -> list[Column]:
        return [F.substr(s, F.lit(1), half(s)).alias(left), F.substr(s, half(s) + 1, F.length(s)).alias(right)]

    def start(e: Column) -> Column:
        kind = F.when(F.array_contains(known, e), "person").otherwise(_kind(e))
        alphabets = lambda kind: F.when((kind == "hex") & ~e.rlike("[A-F]"), _strings(_HEX)).when((kind == "hex") & ~e.rlike("[a-f]"), _strings(_HEX_UPPER)).when(kind == "hex", _strings(_HEX_MIXED)).when(kind == "ip", _strings(_OCTETS)).otherwise(_strings(_ALPHABETS))
        return _bind(kind, lambda kind: _bind(parts(e, kind), lambda p: F.struct(e.alias("original"), kind.alias("kind"), *(p[n].alias(n) for n in ("head", "given", "tail", "digits")), *halves(p["body"], "left", "right"), *halves(p["given"], "given_left", "given_right"), alphabets(kind).alias("alphabets"))))

    def step(n: int, x: Column) -> Column:
        mine, other = ("left", "right") if n % 2 == 0 else ("right", "left")
        head = F.when(x["kind"] == "person", "").otherwise(F.lower(x["head"]))  # a name's words don't depend on each other
        seed = lambda part: F.concat_ws("|", F.lit(f"{key}|{n}"), x["kind"], F.length(x[part + "left"]).cast("string"), head, F.when(x["kind"] == "email", F.lower(x["tail"])), F.lower(x[part + other]))
        moved = {mine: _shift(x[mine], seed(""), x["alphabets"]), "given_" + mine: F.when(x["given"] == "", "").otherwise(_shift(x["given_" + mine], seed("given_"), x["alphabets"]))}
        return F.struct(*(moved[n].alias(n) if n in moved else x[n].alias(n) for n in ("original", "kind", "head", "given", "tail", "digits", "left", "right", "given_left", "given_right", "alphabets")))

    def finish(x: Column) -> Column:
        body = F.concat(x["left"], x["right"])
        octets = F.array_join(F.transform(_chars(body), lambda c: (F.instr(F.lit(_OCTETS[0]), c) - 1).cast("string")), ".")
        title = F.regexp_extract(x["head"], rf"^({_TITLE})", 1)
        given = F.trim(F.substr(x["head"], F.length(title) + 1, F.length(x["head"])))
        head = F.when((x["kind"] == "person") & (F.length(given) > 0), F.concat(title, F.element_at(names, given), F.lit(" "))).otherwise(x["head"])
        head = F.when(x["given"] == "", head).otherwise(F.concat(head, x["given_left"], x["given_right"], F.lit(" ")))
        check = (x["tail"].cast("int") + _luhn(x["digits"]) - _luhn(F.regexp_replace(F.concat(x["head"], body), r"\D", "")) + 10) % 10
        made = F.when(x["kind"] == "ip", octets).when(x["kind"] == "card", F.concat(x["head"], body, check.cast("string"))).otherwise(F.concat(head, body, x["tail"]))
        return F.struct(x["kind"].alias("kind"), x["original"].alias("original"), made.alias("surrogate"))

    out = F.transform(entities, start)
    for n in range(ROUNDS):
        out = F.transform(out, partial(step, n))
    return F.transform(out, finish)


def replace_pii(docs: DataFrame, key: str = "tessera", text_col: str = "text") -> DataFrame:
    """docs with its text replaced, and two more columns: pii, an array of (kind, original, surrogate) in the
    order of the text, and n_collisions.

    Null text stays null with an empty array; texts without entities are unchanged; rows are independent, so
    repeated rows and empty tables need nothing special. Columns of docs named pii or n_collisions are replaced.
    """
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    own = {n: prefix + n for n in ("e", "n", "any", "p")}
    rest = [c for c in docs.columns if c not in (text_col, "pii", "n_collisions")]
    text = F.col(text_col)
    found = docs.select(*rest, text_col, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias(own["e"])).withColumn(own["n"], surnames(F.col(own["e"])))
    found = found.withColumn(own["any"], F.when(F.size(own["n"]) > 0, F.concat(F.lit(_ANY + "|(?:"), F.array_join(own["n"], "|"), F.lit(r")(?![\p{L}\d]))"))).otherwise(ANY))
    found = found.withColumn(own["e"], F.when(F.size(own["n"]) > 0, F.regexp_extract_all(text, F.col(own["any"]), F.lit(0))).otherwise(F.col(own["e"])))
    made = found.withColumn(own["p"], F.when(F.size(own["e"]) > 0, surrogates(F.col(own["e"]), key, F.col(own["n"]))))
    pii = F.coalesce(F.col(own["p"]), F.array().cast("array<struct<kind:string,original:string,surrogate:string>>"))
    whole = F.array_join(F.zip_with(F.split(text, F.col(own["any"])), F.transform(own["p"], lambda p: p["surrogate"]), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    originals, replaced = F.array_distinct(F.transform(pii, lambda p: p["original"])), F.array_distinct(F.transform(pii, lambda p: p["surrogate"]))
    clash = F.size(originals) - F.size(replaced) + F.size(F.array_intersect(originals, replaced))
    out = made.select(*rest, F.when(F.size(own["e"]) > 0, whole).otherwise(text).alias(text_col), pii.alias("pii"), F.when(F.size(pii) > 0, clash).otherwise(0).alias("n_collisions"))
    return out.select(*[c for c in docs.columns if c in out.columns and c not in ("pii", "n_collisions")], "pii", "n_collisions")


def collisions(replaced: DataFrame) -> DataFrame:
    """(kind, surrogate, originals) of surrogates that stand for more than one original anywhere: none, if all is well."""
    each = replaced.select(F.explode("pii").alias("p")).select("p.kind", "p.surrogate", "p.original").distinct()
    return each.groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).filter("originals > 1")
