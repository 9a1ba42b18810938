"""Surrogates for personal data, in DataFrame operations only.

Detected: e-mail addresses, telephone numbers (international, with `+` or 00, and national ones in brackets or
with hyphens), card numbers, IPv4 addresses, and names: words after a title, and the same words anywhere else in
that document. A name without a title in the whole document is not detected.

`replace` writes one table of what was detected, makes one surrogate per entity, and joins it back to every
spelling of that entity:

* Entities: the address, its domain, the digits of a number, each word of a name (in lower case). Spellings of one
  entity, such as `+44 207 555 7713` and `0044207 555-7713`, or `Mr. Anna Jones`, `Dr Jones` and `JONES`, share a
  surrogate in all documents, in their own punctuation and capitals.
* Digits go through a keyed Feistel network (SHA-256), a bijection per kind, prefix and length. Country codes stay,
  and a card number keeps the distance of its last digit from the Luhn digit.
* Addresses and domains keep their shape (letters, digits, separators, top-level domain).
* A name word is spelled in syllables of its script; a given name ends by the gender of the titles that it has in
  the corpus, the more frequent one if there are several.
* Collision check over the corpus: where two entities have one surrogate, or a surrogate is an entity of the corpus,
  only these get the key's next attempt (`settle`), which adds letters to words and addresses. Numbers of a prefix and
  length so full that no attempt is free keep the bijection, which keeps them apart, but may be numbers of the corpus.

Null text stays null, text without entities stays as it is, repeated rows (by id, text or both) are treated alike, and
an empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialise, partitions

# Fixed patterns, tried in this order at each place. A domain has 127 labels at most.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}+"
PHONE = r"\+(?:1(?:[ ().-]{0,2}[0-9]){10}|[0-9](?:[ ()./-]{0,2}[0-9]){7,14})(?![0-9])"
IP = r"(?=[0-9])(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])"
CARD_DIGITS = r"(?:[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{16}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|4[0-9]{12}|(?:62|4[0-9])[0-9]{17})(?![0-9A-Za-z])"
CARD = r"(?=[0-9])(?<![0-9A-Za-z])" + CARD_DIGITS
NATIONAL = r"(?<![0-9A-Za-z+])(?:00[1-9](?:[ ()./-]{0,2}[0-9]){7,14}|\([0-9]{2,5}\) ?[0-9]{3,4}[ -]?[0-9]{4}|[0-9]{3,4}-[0-9]{3,4}-[0-9]{4})(?![0-9])"
TITLES = {"m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "n": ["Dr", "Prof"]}
PARTICLES = "von van der den de del la di da du bin al".split()
_CAPITAL = r"(?:\p{Lu}[\p{L}\p{M}'’]*+|\p{Lo}++)"
_WORD = _CAPITAL + r"(?:-" + _CAPITAL + "){0,4}+"
TITLE = r"(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? "
NAME = r"(?=\p{Lu})(?<![\p{L}\p{N}])" + TITLE + r"(?:(?:" + "|".join(PARTICLES) + r") ){0,3}+" + _WORD + r"(?: (?:(?:" + "|".join(PARTICLES) + r") ){0,3}+" + _WORD + r"){0,4}+(?![\p{L}\p{N}])"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, IP, CARD, NATIONAL, NAME))
LETTERS = r"[\p{L}\p{M}'’]+"
TYPES = ("email", "phone", "ip", "card", "name")

# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

#: Syllables by script, one per hexadecimal digit, and endings by script and gender.
SYLLABLES = {
    "latin": "ba be bi do du fa ge ka le li mo na ra sa te vi".split(),
    "greek": "βα γε δι ζο θα κε λι μο να πε ρι σο τα φε χι ψα".split(),
    "cyrillic": "ба ве ги до жу за ке ли мо на пе ри со та фу ха".split(),
    "han": list("安伯成达恩方光海嘉康林明宁平清文"),
    "hangul": list("가나다라마바사아자하고노도보소조"),
    "kana": list("かきくさしたちなにのはまみやらり"),
    "arabic": list("ابتجحدرزسشعفقكلم"),
    "hebrew": list("אבגדהוזחטילמנסער"),
}
ENDINGS = {"latin": {"m": "n", "f": "ra", "n": "l"}, "greek": {"m": "ς", "f": "να", "n": "ν"}, "cyrillic": {"m": "н", "f": "на", "n": "й"}}
SCRIPTS = {"cyrillic": "Cyrillic", "greek": "Greek", "hangul": "Hangul", "kana": "Hiragana}\\p{IsKatakana", "han": "Han", "arabic": "Arabic", "hebrew": "Hebrew"}
ROUNDS = 6
#: Attempts of the key for entities that collide, and after so many all numbers of a full class keep their bijection.
ATTEMPTS = 12
_HEX = "0123456789abcdef"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kind(value: Column) -> Column:
    """The type of a detected spelling."""
    return (
        F.when(value.contains("@"), "email").when(value.startswith("+"), "phone").when(value.rlike(f"^(?:{IP})$"), "ip").when(value.rlike(f"^(?:{CARD_DIGITS})$"), "card").when(value.rlike("^[0-9(]"), "phone").otherwise("name")
    )


def names_too(first: Column) -> Column:
    """The pattern that also finds the words of a document's titled names where they stand alone; null if it has none."""
    names = F.filter(first, lambda v: ~v.rlike("^[^ ]*@|^[0-9+(]"))
    words = F.flatten(F.transform(names, lambda v: F.regexp_extract_all(F.regexp_replace(v, "^" + TITLE, ""), F.lit(LETTERS), F.lit(0))))
    plain = F.filter(words, lambda w: ~w.isin(PARTICLES) & ((F.length(w) > 2) | w.rlike(r"^\p{Lo}{2}")))
    plain = F.array_union(plain, F.transform(plain, F.upper))
    one = F.concat(F.lit("(?:"), F.array_join(F.array_sort(plain, lambda a, b: F.length(b) - F.length(a)), "|"), F.lit(")"))
    alone = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])"), one, F.lit("(?:[ -]"), one, F.lit(r"){0,4}+(?![\p{L}\p{N}])"))
    return F.when(F.size(plain) > 0, alone)


def _parts(value: Column) -> Column:
    """A spelling cut into (kind, entity, part): parts of kind `as it is` have no entity."""
    part = lambda k, e, p: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), e.alias("entity"), p.alias("part"))
    none = F.lit(None).cast("string")
    low = F.lower(value)
    email = F.array(part("email", low, F.regexp_extract(value, "^[^@]*", 0)), part("as it is", none, F.lit("@")), part("domain", F.regexp_replace(low, "^[^@]*@", ""), F.regexp_replace(value, "^[^@]*@", "")))
    bare = digits(value)
    number = F.when(value.startswith("+"), F.concat(F.lit("+"), bare)).when(bare.rlike("^00[1-9]"), F.concat(F.lit("+"), F.substring(bare, F.lit(3), F.length(bare)))).otherwise(bare)
    title = F.regexp_extract(value, "^" + TITLE, 0)
    rest = F.substring(value, F.length(title) + 1, F.length(value))
    pieces = F.regexp_extract_all(rest, F.lit(f"{LETTERS}|[^\\p{{L}}\\p{{M}}'’]+"), F.lit(0))
    is_word = lambda p: p.rlike(f"^{LETTERS}$") & ~p.isin(PARTICLES)
    name = F.concat(F.array(part("as it is", none, title)), F.transform(pieces, lambda p: part(F.when(is_word(p), "word").otherwise("as it is"), F.when(is_word(p), F.lower(p)), p)))
    k = kind(value)
    return F.when(k == "email", email).when(k == "phone", F.array(part("phone", number, value))).when(k == "card", F.array(part("card", bare, value))).when(k == "ip", F.array(part("ip", value, value))).otherwise(name)


def _mac(key: str, *what: Column) -> Column:
    """A keyed digest as hexadecimal digits; the key enters on both sides."""
    inner = F.sha2(F.concat_ws("/", F.lit(key), *what), 256)
    return F.sha2(F.concat_ws("/", F.lit(key), inner), 512)


def _number(mac: Column) -> Column:
    return F.conv(F.substring(mac, 1, 15), 16, 10).cast("long")


def _shape(value: Column, mac: Column) -> Column:
    """value with each letter and digit replaced from the digest."""
    letters, numbers = F.translate(mac, _HEX, "abcdefghijklmnop"), F.translate(mac, "abcdef", "012345")
    at = lambda s, i: F.substring(s, i % 128 + 1, F.lit(1))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[a-z]"), at(letters, i)).when(c.rlike("[0-9]"), at(numbers, i)).otherwise(c)), "")


def _check_digit(body: Column) -> Column:
    """The Luhn digit of a digit string."""
    values = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1))
    return F.pmod(-F.aggregate(values, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)), F.lit(10))


def _syllables(mac: Column, count: Column, table: list[str]) -> Column:
    of = F.array(*[F.lit(s) for s in table])
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.get(of, F.conv(F.substring(mac, i, F.lit(1)), 16, 10).cast("int"))), "")


def script(word: Column) -> Column:
    out = F.lit("latin")
    for name, block in SCRIPTS.items():
        out = F.when(word.rlike(rf"[\p{{Is{block}}}]"), name).otherwise(out)
    return out


def make(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, entity, gender, attempt) with `made`, the surrogate in canonical form, and `class`, within which surrogates must differ."""
    e, k, attempt = F.col("entity"), F.col("kind"), F.col("attempt").cast("string")
    international = F.when(F.substring(e, 2, 1).isin("1", "7"), F.substring(e, 1, 2)).when(F.substring(e, 2, 2).isin(TWO_DIGIT_CODES), F.substring(e, 1, 3)).otherwise(F.substring(e, 1, 4))
    head = F.when((k == "phone") & e.startswith("+"), international).when((k == "phone") & e.startswith("0"), "0").otherwise("")
    rows = entities.withColumn("head", head).withColumn("mac", _mac(key, k, attempt, e))
    # Numbers as two halves below two moduli.
    tail = F.when(k == "phone", F.substring(e, F.length("head") + 1, F.length(e))).when(k == "card", F.substring(e, F.lit(1), F.length(e) - 1)).otherwise("00")
    rows = rows.withColumn("body", tail).withColumn("n", F.length("body")).withColumn("a", (F.col("n") / 2).cast("int"))
    octet = lambda i: F.coalesce(F.get(F.split(e, r"\."), F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
    is_ip = k == "ip"
    half = lambda text: F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumn("ml", F.when(is_ip, 65536).otherwise(F.pow(F.lit(10.0), "a")).cast("long")).withColumn("mr", F.when(is_ip, 65536).otherwise(F.pow(F.lit(10.0), F.col("n") - F.col("a"))).cast("long"))
    rows = rows.withColumn("l", F.when(is_ip, octet(0) * 256 + octet(1)).otherwise(half(F.substring("body", F.lit(1), F.col("a")))))
    rows = rows.withColumn("r", F.when(is_ip, octet(2) * 256 + octet(3)).otherwise(half(F.substring("body", F.col("a") + 1, F.col("n")))))
    for step in range(ROUNDS):
        to, other, m = ("l", "r", "ml") if step % 2 == 0 else ("r", "l", "mr")
        rows = rows.withColumn(to, F.pmod(F.col(to) + _number(_mac(key, F.lit(f"step {step}"), k, "head", F.col("n").cast("string"), attempt, F.col(other).cast("string"))), F.col(m)))
    new = F.concat(F.lpad(F.col("l").cast("string"), F.col("a"), "0"), F.lpad(F.col("r").cast("string"), F.col("n") - F.col("a"), "0"))
    phone = F.concat("head", new)
    last = F.pmod(F.right(e, F.lit(1)).try_cast("int") - _check_digit(F.col("body")) + _check_digit(new), F.lit(10))
    card = F.concat(new, last.cast("string"))
    ip = F.concat_ws(".", F.shiftright("l", 8), F.col("l") % 256, F.shiftright("r", 8), F.col("r") % 256)
    more = F.translate(F.substring("mac", F.lit(65), F.col("attempt")), _HEX, "abcdefghijklmnop")
    email = F.concat(_shape(F.regexp_extract(e, "^[^@]*", 0), F.col("mac")), more)
    labels = F.regexp_extract(e, r"^(.*)\.[^.]*$", 1)
    domain = F.concat(_shape(F.when(labels == "", e).otherwise(labels), F.col("mac")), more, F.regexp_extract(e, r"\.[^.]*$", 0))
    of = script(e)
    count = (F.when(of.isin("han", "hangul", "kana", "arabic", "hebrew"), F.greatest(F.length(e), F.lit(2))).otherwise(F.greatest((F.length(e) / 2).cast("int"), F.lit(3))) + F.col("attempt")).cast("int")
    count = F.least(count, F.lit(128))
    word = None
    for name, table in SYLLABLES.items():
        ends = ENDINGS.get(name)
        ending = F.when(F.col("gender") == "m", ends["m"]).when(F.col("gender") == "f", ends["f"]).when(F.col("gender") == "n", ends["n"]).otherwise("") if ends else F.lit("")
        spelled = F.concat(_syllables(F.col("mac"), count, table), ending)
        word = F.when(of == name, spelled) if word is None else word.when(of == name, spelled)
    made = F.when(k == "email", email).when(k == "domain", domain).when(k == "phone", phone).when(k == "card", card).when(k == "ip", ip).otherwise(word)
    within = F.when(k == "email", F.regexp_replace(e, "^[^@]*@", "")).otherwise("")
    return rows.withColumn("made", made).withColumn("class", within).select("kind", "entity", "gender", "attempt", "class", "made")


def settle(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, entity, gender) with surrogates (kind, entity, made), no two alike and none an entity of the corpus."""
    spark = entities.sparkSession
    spread = lambda df: df.repartition(partitions(spark), "kind", "entity")
    rows = materialise(make(spread(entities).withColumn("attempt", F.lit(0)), key), "surrogates")
    for attempt in range(1, ATTEMPTS + 1):
        by = ["kind", "class", "made"]
        shared = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("attempt", "entity")).alias("first")).filter("n > 1")
        twice = rows.join(shared, by).filter("entity <> first.entity").select("kind", "entity")
        real = rows.filter("kind <> 'email'").join(rows.select("kind", F.col("entity").alias("made")), ["kind", "made"], "left_semi").select("kind", "entity")
        again = materialise(twice.unionByName(real).distinct(), "collisions")
        if again.isEmpty():
            break
        if attempt == ATTEMPTS:
            if not again.filter("kind NOT IN ('phone', 'card', 'ip')").isEmpty():
                raise ValueError("no attempt of this key keeps all entities apart; choose another key")
            full = again.select("kind", F.length("entity").alias("len"), F.substring("entity", 1, 1).alias("start")).distinct()
            here = [F.col("kind"), F.length("entity").alias("len"), F.substring("entity", 1, 1).alias("start")]
            in_full = rows.select("entity", "gender", *here).join(full, ["kind", "len", "start"], "left_semi").select("kind", "entity", "gender", F.lit(0).alias("attempt"))
            rest = rows.join(in_full.select("kind", "entity"), ["kind", "entity"], "left_anti")
            rows = materialise(rest.unionByName(make(spread(in_full), key)), "surrogates")
            break
        new = rows.join(again, ["kind", "entity"]).select("kind", "entity", "gender", F.lit(attempt).alias("attempt"))
        rows = materialise(rows.join(again, ["kind", "entity"], "left_anti").unionByName(make(spread(new), key)), "surrogates")
    return rows.select("kind", "entity", "made")


def _refill(part: Column, new: Column) -> Column:
    """part with its digits replaced, in order, by those of new."""
    gaps = F.split(part, "[0-9]", -1)
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.split(new, ""), lambda g, d: F.concat(g, d)), ""), F.element_at(gaps, -1))


def _spelled(part: Column, made: Column, k: Column) -> Column:
    """A surrogate in the punctuation and capitals of a part."""
    new = F.when(digits(part).rlike("^00[1-9]") & made.startswith("+"), F.concat(F.lit("00"), digits(made))).otherwise(digits(made))
    word = F.when((F.length(part) > 1) & (part == F.upper(part)) & (part != F.lower(part)), F.upper(made)).when(F.left(part, F.lit(1)) == F.upper(F.left(part, F.lit(1))), F.initcap(made)).otherwise(made)
    return F.when(k.isin("phone", "card"), _refill(part, new)).when(k == "word", word).otherwise(made)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, written: row, doc_id, text, pattern (null for the common one), found (spellings in order)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("first", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    rows = rows.withColumn("pattern", F.when(F.size("first") > 0, names_too(F.col("first"))))
    found = F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("first"))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "pattern", found.alias("found")), "detected")


def spellings(detected: DataFrame, key: str) -> DataFrame:
    """(value, kind, made, times): every distinct spelling with its surrogate."""
    spark = detected.sparkSession
    values = detected.select(F.explode("found").alias("value")).groupBy("value").agg(F.count("*").alias("times"))
    values = materialise(values.repartition(partitions(spark), "value"), "values")
    parts = materialise(values.select("value", "times", F.posexplode(_parts(F.col("value"))).alias("place", "p")).select("value", "times", "place", "p.*"), "parts")
    title = F.regexp_replace(F.regexp_extract("value", "^" + TITLE, 0), r"[. ]", "")
    words = parts.filter("kind = 'word'")
    last = words.groupBy("value").agg(F.max("place").alias("last"), F.count("*").alias("words"))
    given = words.join(last, "value").filter("words > 1 AND place < last").withColumn("t", title)
    sexes = given.groupBy("entity").agg(F.sum(F.when(F.col("t").isin(TITLES["m"]), F.col("times")).otherwise(0)).alias("m"), F.sum(F.when(F.col("t").isin(TITLES["f"]), F.col("times")).otherwise(0)).alias("f"))
    sexes = sexes.select(F.lit("word").alias("kind"), "entity", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n").alias("gender"))
    distinct = parts.filter("entity IS NOT NULL").select("kind", "entity").distinct().join(sexes, ["kind", "entity"], "left")
    made = settle(distinct, key)
    # A domain or a word may be in very many spellings.
    known = parts.filter("entity IS NOT NULL").withColumn("of", F.struct("kind", "entity")).drop("kind", "entity")
    often = known.groupBy("of").agg(F.count("*").alias("parts")).join(made.select(F.struct("kind", "entity").alias("of"), "made"), "of")
    spelled = join_groups(known, often, "of", "parts", known.count()).select("value", "place", _spelled(F.col("part"), F.col("made"), F.col("of.kind")).alias("made"))
    spelled = spelled.unionByName(parts.filter("entity IS NULL").select("value", "place", F.col("part").alias("made")))
    whole = spelled.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "made"))), lambda p: p["made"]), "").alias("made"))  # a few parts each
    return materialise(whole.join(values, "value").select("value", kind(F.col("value")).alias("kind"), "made", "times"), "spellings")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (with surrogates), entities (array of kind, start, end in the old text, surrogate)."""
    detected = detect(docs, id_col, text_col)
    made = spellings(detected, key)
    hits = detected.filter("size(found) > 0").select("row", F.posexplode("found").alias("place", "value"))
    total = made.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    of_row = join_groups(hits, made, "value", "times", total).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "value", "kind", "made"))).alias("made"))  # one document's own
    rows = detected.filter("size(found) > 0").select("row", "doc_id", "text", "pattern").join(of_row, "row")
    gaps = F.when(F.col("pattern").isNull(), F.split("text", ENTITY, -1)).otherwise(F.split("text", F.col("pattern"), -1))
    rows = rows.withColumn("gaps", gaps)
    kinds = "array<struct<kind:string,start:int,end:int,surrogate:string>>"
    # Running sums of the lengths of gaps and spellings give the places in the old text.
    steps = F.zip_with(F.slice("gaps", F.lit(1), F.size("made")), "made", lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["value"]).alias("n"), m["kind"].alias("kind"), m["made"].alias("made")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("out"))
    spans = F.aggregate(
        steps,
        start,
        lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.concat(s["out"], F.array(F.struct(x["kind"].alias("kind"), (s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end"), x["made"].alias("surrogate")))).alias("out")),
        lambda s: s["out"],
    )
    new = F.concat(F.array_join(F.flatten(F.zip_with(F.slice("gaps", F.lit(1), F.size("made")), "made", lambda g, m: F.array(g, m["made"]))), ""), F.element_at("gaps", -1))
    plain = detected.filter("found IS NULL OR size(found) <= 0").select("doc_id", "text", F.array().cast(kinds).alias("entities"))
    return rows.select("doc_id", new.alias("text"), spans.alias("entities")).unionByName(plain)
