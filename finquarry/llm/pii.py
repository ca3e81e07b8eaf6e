"""Surrogates for personal data and secrets, in DataFrame functions only.

One pattern finds the entities. Mentions become rows, and a name or short phone number that stands for a longer one of
its text takes that one's normal form by joins. A surrogate is drawn from a keyed hash of type and normal form, so every
mention of an entity, in whatever spelling, gets the same one. It keeps type, format and script: digits stay digits
between the same separators, letters stay in their script, cards keep their issuer digit and a valid check digit,
addresses stay valid, titled names keep title, gender and alphabet. A table of distinct entities finds surrogates that
two entities share or that occur as real entities; those are drawn again, the free forms longer each time.

Repeated groups of the patterns are bounded or possessive, so that no text can exhaust the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import drop_staged, fresh, salted, sized, stage

# Titles by gender, and the name parts of each alphabet.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "г-жа"]
NAMES = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Henri", "Ivan", "Jonas", "Karl", "Louis", "Marco", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"],
    "cyrillic": ["ба", "ве", "ги", "до", "жа", "зе", "ки", "ло", "ма", "не", "по", "ра", "се", "ти", "фо", "ша"],
}

#: Letters that stand for a to z in other scripts, from the first letter of each on; capitals follow.
SCRIPTS = {s: "".join(chr(first + step * i) for i in range(26)) for s, first, step in (
    ("Cyrillic", 0x0430, 1), ("Hebrew", 0x05D0, 1), ("Devanagari", 0x0915, 1), ("Thai", 0x0E01, 1), ("Armenian", 0x0561, 1), ("Georgian", 0x10D0, 1),
    ("Hiragana", 0x304B, 2), ("Katakana", 0x30AB, 2), ("Hangul", 0xAC00, 28), ("Han", 0x4E00, 32),
)} | {"Greek": "αβγδεζηθικλμνξοπρστυφχψωαε", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنه"}
_ABC = "abcdefghijklmnopqrstuvwxyz"

_TITLE = "|".join(MALE + FEMALE)
_TITLED = rf"^(?:{_TITLE})\.? "
_OF = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|ter|bin|al|el) ){0,4}+"
_PART = r"(?:\p{Lu}\.(?= \p{Lu})|\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{Lu}[\p{L}\p{M}]*+|-\p{L}[\p{L}\p{M}]*+){0,9}+)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"[\p{L}\p{N}._%+-]"
_SECRET = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?)"
#: Kinds in order of precedence, with their patterns. Mail addresses have the lengths that the mail standards allow.
KINDS = {
    "secret": _SECRET + r"[^\s\"]{6,}+",
    "email": rf"(?<!{_WORD}){_WORD}{{1,64}}+@(?:[\p{{L}}\p{{N}}-]{{1,63}}\.){{1,126}}\p{{L}}{{2,63}}",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9-]{16,}+",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|(?<![\d-])\d{3}[-. ]\d{3}[-. ]\d{4}\b(?!-)",
    "card": r"(?<![\d-])[3-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{3,4}\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": rf"(?<![\p{{L}}-])(?:{_TITLE})\.? {_OF}{_PART}(?: {_OF}{_PART}){{0,11}}+",
}
#: No entity begins inside a word, unless with a digit, plus or bracket: most places of a text fail this one test.
PATTERN = r"(?:(?<!\p{L})|(?=[\d+(]))(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: What every text with a match has: a digit, an at sign, or the start of a secret, key or titled name.
_MAYBE = rf"[0-9@]|(?<!\p{{L}})(?:{_SECRET}|AKIA|ASIA|ghp_|sk-|xox[bp]-|(?:{_TITLE})\.? {_OF}\p{{Lu}})"
#: Country calling codes of one and two digits; all others have three.
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def kind(e: Column) -> Column:
    out = F.lit("name")
    for k, p in reversed(list(KINDS.items())[:-1]):
        out = F.when(e.rlike(f"^(?:{p})$"), F.lit(k)).otherwise(out)
    return out


def _value(e: Column, k: Column) -> Column:
    """What of a match is replaced: a secret's value and a name behind its title; else all of it."""
    return F.when(k == "secret", F.regexp_replace(e, f"^{_SECRET}", "")).when(k == "name", F.regexp_replace(e, _TITLED, "")).otherwise(e)


def normal_form(e: Column, k: Column) -> Column:
    """The same for all spellings of an entity: case of addresses and separators of numbers do not count. The title's
    gender is part of a name."""
    gender = F.when(e.rlike(rf"^(?:{'|'.join(MALE)})\b\.? "), "m:").otherwise("f:")
    number = F.regexp_replace(e, r"\D", "")
    out = F.when(k == "email", F.lower(e)).when(k == "phone", F.concat(F.when(e.startswith("+"), "+").otherwise(""), number)).when(k.isin("card", "ssn"), number)
    return out.when(k == "iban", F.replace(e, F.lit(" "))).when(k == "name", F.concat(gender, _value(e, k))).otherwise(_value(e, k))


def untitled(found: Column) -> Column:
    """A pattern of the full names and surnames behind titles in an array of matches; null if none. Names stand by their
    first letter, longest first, so that a place in the text is tried against few of them."""
    names = F.transform(F.filter(found, lambda e: e.rlike(_TITLED)), lambda e: F.regexp_replace(e, _TITLED, ""))
    both = F.array_distinct(F.concat(names, F.transform(names, lambda v: F.regexp_extract(v, r"[^ ]+$", 0))))
    longest = F.transform(F.reverse(F.array_sort(F.transform(F.filter(both, lambda v: F.length(v) > 1), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))), lambda x: x["v"])

    def alike(c: Column) -> Column:
        rest = F.transform(F.filter(longest, lambda v: v.startswith(c)), lambda v: F.concat(F.lit(r"\Q"), F.substring(v, 2, 1 << 20), F.lit(r"\E")))
        return F.concat(c, F.lit("(?:"), F.array_join(rest, "|"), F.lit(")"))

    by_letter = F.array_join(F.transform(F.array_distinct(F.transform(longest, lambda v: F.substring(v, 1, 1))), alike), "|")
    return F.when(F.size(longest) > 0, F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_-])(?:"), by_letter, F.lit(r")(?![\p{L}\p{M}\p{N}_]|['’-]\p{Lu})")))


def _shorter_forms(v: Column) -> Column:
    """What may stand for a name: its last words, or its first ones and the last."""
    words = F.split(v, " ")
    n = F.size(words)
    last = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i > 1, F.array_join(F.slice(words, i, n - i + 1), " ")))
    first = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n - 1, F.concat_ws(" ", F.array_join(F.slice(words, F.lit(1), i), " "), F.element_at(words, -1))))
    return F.array_distinct(F.array_compact(F.concat(last, first)))


def coreferent(mention: DataFrame) -> DataFrame:
    """Mentions (id, pos, entity, kind, norm) with the normal form of what they stand for in their text.

    A part of a titled name takes the form of the one longer name of its text that it fits and whose gender it has; a
    mention without title that of the first titled name it fits; a number without country code that of the one
    number with it that it ends.
    """
    names = mention.filter("kind = 'name'").withColumns({"v": _value(F.col("entity"), F.col("kind")), "gender": F.substring("norm", 1, 1), "titled": F.col("entity").rlike(_TITLED)})
    known = names.filter("titled").groupBy("id", "gender", "v").agg(F.min("pos").alias("pos"))
    known = known.withColumn("now", F.concat_ws(":", "gender", "v"))
    for _ in range(2):  # a part of a part needs a second look
        forms = known.select("id", "gender", F.explode(_shorter_forms(F.col("v"))).alias("v"), F.col("now").alias("whole"))
        one = forms.groupBy("id", "gender", "v").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).filter("a = b").select("id", "gender", "v", "a")
        known = known.join(one, ["id", "gender", "v"], "left").withColumn("now", F.coalesce("a", "now")).drop("a")
    known = stage(known, "pii-names")
    first = known.select("id", F.explode(F.array_append(_shorter_forms(F.col("v")), F.col("v"))).alias("v"), "pos", "now").groupBy("id", "v").agg(F.min_by("now", "pos").alias("now"))
    cols = ["id", "pos", "entity", "kind"]
    titled = names.filter("titled").join(known.select("id", "gender", "v", "now"), ["id", "gender", "v"]).select(*cols, F.col("now").alias("norm"))
    bare = names.filter("not titled").join(first, ["id", "v"], "left").select(*cols, F.coalesce("now", "norm").alias("norm"))

    phones = mention.filter("kind = 'phone'")
    whole = phones.filter("norm like '+%'").select("id", F.col("norm").alias("now"), F.explode(F.transform(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda i: F.substr("norm", i, F.lit(40)))).alias("norm")).filter(F.length("norm") >= 7)
    whole = whole.groupBy("id", "norm").agg(F.min("now").alias("a"), F.max("now").alias("b")).filter("a = b").select("id", "norm", "a")
    short = phones.join(whole, ["id", "norm"], "left").select(*cols, F.coalesce("a", "norm").alias("norm"))
    return mention.filter("kind not in ('name', 'phone')").unionByName(titled).unionByName(bare).unionByName(short)


def _like(c: Column, d: Column, a: Column) -> Column:
    """A digit for a digit, a letter of the same script and case for a letter; other characters stay."""
    out = F.when(c.between("0", "9"), d).when(c.between("a", "z"), a).when(c.between("A", "Z"), F.upper(a)).when(c < "\x80", c)
    cased = lambda x: F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)
    for script, letters in SCRIPTS.items():
        out = out.when(c.rlike(rf"[\p{{Is{script}}}&&\p{{L}}]"), cased(F.translate(a, _ABC, letters)))
    return out.when(c.rlike(r"\p{Nd}"), d).when(c.rlike(r"\p{L}"), cased(a)).otherwise(c)


def _fill(value: Column, digits: Column, letters: Column) -> Column:
    """value with each letter or digit replaced by that of the streams at its place, in one linear pass."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: _like(c, F.substr(digits, i % 129 + 1, F.lit(1)), F.substr(letters, i % 129 + 1, F.lit(1)))), "")


def _fill_numbers(value: Column, digits: Column, letters: Column) -> Column:
    """value, of at most some forty characters, with its k-th letter or digit replaced by the k-th of the streams,
    whatever stands between them."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        new = F.when(c.between("0", "9"), F.substr(digits, acc["k"], F.lit(1))).when(c.between("A", "Z"), F.upper(F.substr(letters, acc["k"], F.lit(1)))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["k"] + F.when(c.rlike(r"[A-Z0-9]"), 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The check digit that completes a string of digits."""
    n = F.length(digits)

    def part(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), part)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def with_surrogates(mention: DataFrame, key: str) -> DataFrame:
    """Rows (…, entity, kind, norm, attempt) with `s`, the replacement of entity. Each attempt draws another; those of
    names, addresses and secrets grow longer with it, as short forms can run out."""
    seed = F.concat_ws("|", F.lit(key), "kind", "norm", "attempt")
    m = mention.withColumn("value", _value(F.col("entity"), F.col("kind")))
    m = m.withColumns({"hexes": F.concat(*[F.sha2(F.concat_ws("|", seed, F.lit(i)), 256) for i in range(3)])})
    letters = F.translate(F.lower(F.concat(*[F.base64(F.unhex(F.substring("hexes", 64 * i + 1, 64))) for i in range(3)])), "0123456789+/=", "klmnopqrstuvj")
    m = m.withColumns({"digits": F.translate("hexes", "abcdef", "012345"), "letters": letters})
    e, k, value, hexes, digits, abc = (F.col(c) for c in ("entity", "kind", "value", "hexes", "digits", "letters"))
    more = F.substr(abc, F.lit(40), F.greatest(F.col("attempt") - 2, F.lit(0)))
    own = F.regexp_replace(e, r"\D", "")
    body = F.concat(F.substring(own, 1, 1), F.substr(digits, F.lit(1), F.length(own) - 2))
    number = F.regexp_replace("norm", r"\D", "")  # of the entity, which a mention may give without its country
    code = F.when(F.col("norm").startswith("+"), F.regexp_extract(number, CALLING, 0)).otherwise("")
    number = F.concat(code, F.substr(digits, F.lit(1), F.length(number) - F.length(code)))
    # Kept in front, what is replaced sign by sign, kept behind.
    before = F.when(k == "key", F.regexp_extract(e, "^(AKIA|ASIA|ghp_|sk-|xox[bp]-)", 0)).when(k == "iban", F.substring(e, 1, 2)).when(k.isin("secret", "name"), F.substr(e, F.lit(1), F.length(e) - F.length(value))).otherwise("")
    behind = F.when(k == "email", F.regexp_extract(e, r"\.\p{L}+$", 0)).otherwise("")
    m = m.withColumns({"before": before, "behind": behind, "body": F.substr(e, F.length(before) + 1, F.length(e) - F.length(before) - F.length(behind))})
    stream = F.when(k == "card", F.concat(body, _luhn(body))).when(k == "phone", F.substr(number, F.length(number) - F.length(own) + 1, F.length(own))).otherwise(digits)
    m = m.withColumns({"stream": stream, "more": more})
    octet = [F.conv(F.substring(hexes, 2 * i + 1, 2), 16, 10).cast("int") for i in range(4)]
    ip = F.concat_ws(".", F.pmod(octet[0], F.lit(223)) + 1, octet[1], octet[2], F.pmod(octet[3], F.lit(254)) + 1)
    s = F.when(k == "ip", ip).when(k == "name", F.concat("before", _person(value, F.col("norm"), hexes, digits, abc, F.col("attempt"))))
    s = s.when(k.isin("phone", "card", "ssn", "iban"), F.concat("before", _fill_numbers(F.col("body"), F.col("stream"), abc)))
    s = s.when((k == "secret") & F.col("body").rlike("^[0-9a-f]{1,192}$"), F.concat("before", F.substr(hexes, F.lit(1), F.length("body")), "more"))
    s = s.otherwise(F.concat(F.when(k == "email", F.col("more")).otherwise(""), "before", _fill(F.col("body"), digits, abc), "behind", F.when(k == "secret", F.col("more")).otherwise("")))
    return m.withColumn("s", s).drop("value", "hexes", "digits", "letters", "before", "behind", "body", "stream", "more")


def _pick(values: list[str], hexes: Column, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.conv(F.substr(hexes, at, F.lit(1)), 16, 10).cast("int") + 1)


def _person(value: Column, norm: Column, hexes: Column, digits: Column, letters: Column, attempt: Column) -> Column:
    """A surname of five syllables, and one more with each attempt, behind a given name of the gender if there was one.
    Names in other alphabets than Latin and Cyrillic get letters of their own script in place of their letters."""
    many = F.sequence(F.lit(2), F.lit(6) + F.least(attempt, F.lit(60)))

    def in_script(s: str) -> Column:
        last = F.initcap(F.array_join(F.transform(many, lambda i: _pick(SYLLABLES[s], hexes, i)), ""))
        first = F.when(norm.startswith("m:"), _pick(NAMES[s, "m"], hexes, F.lit(1))).otherwise(_pick(NAMES[s, "f"], hexes, F.lit(1)))
        return F.when(value.rlike(r"^\p{Lu}[^ ]* "), F.concat_ws(" ", first, last)).otherwise(last)

    latin, cyrillic = value.rlike(r"^[\p{IsLatin}\P{L}]*$"), value.rlike(r"^[\p{IsCyrillic}\P{L}]*$")
    surname = F.regexp_extract(norm, r"[^ :]+$", 0)
    longer = F.concat(surname, F.repeat(F.lower(F.substring(surname, -1, 1)), attempt))
    given = F.regexp_extract(value, r"^(\p{Lu}[^ ]* )", 1)  # behind the surname, so that mentions without it agree
    both = F.split(_fill(F.concat(longer, F.lit("\n"), given), digits, letters), "\n")
    return F.when(cyrillic & ~latin, in_script("cyrillic")).when(latin, in_script("latin")).otherwise(F.concat(both[1], both[0]))


def draw_surrogates(entities: DataFrame, key: str, rounds: int) -> DataFrame:
    """The attempt (kind, norm, attempt) of each entity (kind, norm, entity) whose surrogate no other entity has and
    that is no entity of the texts itself. Each round draws only those again that collided."""
    real, settled, left = entities.select("kind", F.col("norm").alias("s")), None, entities.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        trial = with_surrogates(left, key).withColumn("s", normal_form(F.col("s"), F.col("kind")))
        trial = stage(trial, "pii-drawn")
        others = real if settled is None else real.unionByName(settled.select("kind", "s"))
        taken = others.join(sized(trial.select("kind", "s"), 128), ["kind", "s"], "left_semi").distinct().withColumn("taken", F.lit(True))
        keeps = trial.groupBy("kind", "s").agg(F.min("norm").alias("keeps"))
        judged = stage(trial.join(keeps, ["kind", "s"]).join(taken, ["kind", "s"], "left").select("kind", "norm", "entity", "attempt", "s", (F.col("taken").isNotNull() | (F.col("norm") != F.col("keeps"))).alias("bad")), "pii-judged")
        drop_staged(trial)
        good = judged.filter("not bad").select("kind", "norm", "attempt", "s")
        settled = good if settled is None else settled.unionByName(good)
        left = judged.filter("bad").select("kind", "norm", "entity", (F.col("attempt") + 1).alias("attempt"))
        if left.isEmpty():
            return settled
    raise RuntimeError(f"surrogates still collide after {rounds} draws: a fixed format has too few values left")


def replace_pii(docs: DataFrame, key: str = "k1", rounds: int = 40, text_col: str = "text") -> DataFrame:
    """docs with surrogates in text_col, all columns and rows kept, and a count of entities, n_entities (with an
    underscore more where docs has such a column).

    Null text stays null with 0 entities; so do texts without entities. Repeated rows get equal results. A name has at
    most 12 parts, a mail address the lengths of the mail standards; what is beyond is not part of it. Only rows with
    entities are written aside; their mentions are rows, so that no text's entities are compared with each other.
    A fixed format (addresses of hosts, numbers) with too few values left ends in an error, never in a shared surrogate.
    """
    n_entities, row_id, found, names_of, drawn = (fresh(docs.columns, c) for c in ("n_entities", "_id", "_found", "_names", "_drawn"))
    text, hits, bare = F.col(f"`{text_col}`"), F.col(found), F.col(names_of)
    seen = docs.withColumn(found, F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    pattern = F.concat_ws("|", F.lit(PATTERN), bare)
    none = F.coalesce(F.size(hits), F.lit(0)) <= 0
    names = [F.col(f"`{c}`") for c in docs.columns]
    clean = seen.filter(none).select(*names, F.lit(0).cast("long").alias(n_entities))
    held = seen.filter(~none).withColumn(names_of, untitled(hits))
    held = held.withColumn(found, F.when(bare.isNull(), hits).otherwise(F.regexp_extract_all(text, pattern, F.lit(0))))
    held = stage(held.withColumn(row_id, F.monotonically_increasing_id()), "pii-found")

    mention = held.select(F.col(row_id).alias("id"), F.posexplode(hits).alias("pos", "entity")).withColumn("kind", kind(F.col("entity")))
    plain = stage(mention.withColumn("norm", normal_form(F.col("entity"), F.col("kind"))), "pii-plain")
    mention = stage(coreferent(plain), "pii-mentions")
    fullest = F.struct(F.col("entity").rlike(_TITLED), F.length("entity"), F.col("entity"))  # a name's title tells its gender
    entities = stage(mention.groupBy("kind", "norm").agg(F.max_by("entity", fullest).alias("entity")), "pii-entities")
    moved = draw_surrogates(entities, key, rounds).filter("attempt > 0").select("kind", "norm", "attempt")
    again = salted(mention, moved, ["kind", "norm"], ["id", "pos"], 128, "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    own = with_surrogates(again, key).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias(drawn)).withColumnRenamed("id", row_id)

    parts = F.when(bare.isNull(), F.split(text, PATTERN, -1)).otherwise(F.split(text, pattern, -1))
    new = F.concat_ws("", F.flatten(F.zip_with(parts, F.col(drawn), lambda p, s: F.array(p, F.coalesce(s["s"], F.lit(""))))))
    fixed = held.join(own, row_id).withColumn(n_entities, F.size(hits).cast("long"))
    drop_staged(plain, entities)
    return clean.unionByName(fixed.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], n_entities))


def pii_query(docs: DataFrame) -> DataFrame:
    """doc_id, text with surrogates and n_entities of every document."""
    return replace_pii(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
