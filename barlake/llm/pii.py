"""Surrogates for personal data: keyed, type-consistent replacements that keep coreference and distinctness.

Main path: built-in functions only. Entities are found by one pattern; each gets a surrogate of its own type, from a keyed
hash of its normal form: digits for digits in the same layout, letters of the same script and case, a valid check digit for
card numbers, given names of the same gender. Equal entities get equal surrogates everywhere. Before anything is replaced,
the distinct entities of the whole table are checked: where two would get one surrogate, or one would get another's real
value, all but one draw again. Surnames are checked as entities of their own, before the names: all who bear one share its
surrogate, and no two surnames have the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import BROADCAST_BYTES, cut, free_name, stored, table

#: Given names by script and gender, for finding names and for replacing them; honorifics by gender.
GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Emma", "Laura", "Julia", "Sophie", "Claire", "Elena", "Sarah", "Alice", "Carmen", "Lucia", "Hannah", "Marie", "Emily", "Olivia"],
    ("latin", "m"): ["Peter", "John", "Thomas", "Michael", "David", "Daniel", "Paul", "Martin", "Lukas", "Pierre", "Carlos", "Miguel", "James", "Robert", "William", "Felix"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Сергей", "Алексей", "Дмитрий", "Андрей", "Михаил", "Николай", "Павел"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"],
}
HONORIFICS = {"f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora"], "m": ["Mr", "Herr", "Monsieur", "Sr", "Señor"], "n": ["Dr", "Prof"]}
#: Alphabets from which letters are replaced within their script and case, and syllables of surnames.
ALPHABETS = {"a-z": "abcdefghijklmnopqrstuvwxyz", "A-Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0-9": "0123456789", "а-яё": "абвгдежзиклмнопрстуфхцчшэюя", "А-ЯЁ": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "α-ω": "αβγδεζηθικλμνξοπρστυφχψω", "Α-Ω": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
SYLLABLES = {"latin": ["ba", "den", "gor", "hal", "ken", "lin", "mar", "nel", "por", "ran", "sel", "tor", "vin", "wal", "zen", "mer"], "cyrillic": ["ба", "вор", "гал", "дан", "кор", "лен", "мир", "нов", "пор", "сев", "тар", "хол"], "greek": ["βα", "δη", "κα", "λι", "μα", "νο", "πα", "ρο", "σα", "τζι"]}

#: Surnames that are common words, too, and stay where a sentence begins with them.
COMMON = ["Will", "May", "Mark", "Rose", "Young", "Long", "Short", "Small", "Rich", "Grant", "Hope", "Law", "Day", "Bill", "Page", "Price", "Major", "West", "East", "North", "South", "King", "White", "Brown", "Black", "Green", "Summer", "Winter", "March", "April", "June", "August", "Case", "Field", "Hill", "Park", "Wood", "Stone", "Banks", "Best", "Good", "Love", "Moon", "Sharp", "Strong", "Wise", "Rush", "Cook", "Hall", "House", "Church"]
#: Parts in which a text's surnames are looked up, at most.
BUCKETS = 256

_honor = "|".join(x for group in HONORIFICS.values() for x in group)
_given = "|".join(x for group in GIVEN.values() for x in group)
_lead = r"(?i:password|passwd|secret|token|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?"
_name = r"\p{Lu}[\p{L}'’-]++"
#: Patterns by type, in order of precedence. Each begins where no entity of its kind can have begun before.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": rf"\bAKIA[0-9A-Z]{{16}}\b|\b{_lead}[A-Za-z0-9_/+.=-]{{8,}}",
    "name": rf"\b(?:{_honor})\.? {_name}(?: {_name})?|\b(?:{_given}) {_name}",
}
#: What an entity may begin with, looked at first: most places of a text fail there.
FIRST = {"iban": "[A-Z]", "card": "[0-9]", "ip": "[0-9]", "phone": "[0-9+(]", "ssn": "[0-9]", "secret": "[AaPpSsTt]", "name": r"\p{Lu}"}
ANY = "|".join(f"(?:(?={FIRST[k]})(?:{p}))" if k in FIRST else f"(?:{p})" for k, p in PATTERNS.items())
#: Whole matches are told apart by these, in this order (what stands around a match is gone then).
KINDS = {"email": "@", "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "phone": r"^(?:\+|\(|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$)", "card": r"^[0-9](?:[ -]?[0-9]){12,18}$", "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$", "name": rf"^(?:(?:{_honor})\.? |(?:{_given}) )"}
#: The digits that payment cards begin with.
ISSUERS = "23456"
#: Attempts from which on kinds of a fixed layout get one more character each, so that no kind runs out.
FIXED = 6
#: The session setting that holds the secret key of the registered query, and the key where it is unset.
KEY_SETTING, OPEN_KEY = "spark.barlake.surrogates.key", "not a secret"


def kind_of(entity: Column) -> Column:
    """The type of a match; `number` for what has a card number's length but isn't one, and stays."""
    out = F.lit("secret")
    digits = F.regexp_replace(entity, "[^0-9]", "")
    card = F.when(digits.rlike(f"^[{ISSUERS}]") & (_luhn(digits) % 10 == 0), "card").otherwise("number")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(entity.rlike(pattern), card if kind == "card" else kind).otherwise(out)
    return out


def normal(entity: Column, kind: Column) -> Column:
    """What two writings of one entity have in common: its type, and case or layout left out."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    person = F.lower(F.regexp_replace(entity, rf"^(?:{_honor})\.? ", ""))
    body = F.when(kind == "email", F.lower(entity)).when(kind.isin("card", "phone", "ssn"), digits).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(kind == "name", F.concat(gender_of(entity), F.lit(" "), person)).when(kind == "secret", F.regexp_replace(entity, f"^{_lead}", "")).when(kind == "surname", F.lower(entity)).otherwise(entity)
    return F.concat(kind, F.lit(":"), body)


def words_of(name: Column) -> Column:
    """A name's words, without a title."""
    return F.split(F.regexp_replace(name, rf"^(?:{_honor})\.? ", ""), " ")


def surname_of(entity: Column, kind: Column) -> Column:
    """The normal form of a name's surname as an entity of its own; null for other kinds."""
    return F.when(kind == "name", normal(F.element_at(words_of(entity), -1), F.lit("surname")))


def gender_of(entity: Column) -> Column:
    out = F.lit("n")
    for gender, titles in HONORIFICS.items():
        names = "|".join(x for (_, g), group in GIVEN.items() for x in group if g == gender)
        found = entity.rlike(rf"^(?:{'|'.join(titles)})\.? ") if not names else entity.rlike(rf"^(?:(?:{'|'.join(titles)})\.? |(?:(?:{_honor})\.? )?(?:{names}) )")
        out = F.when(found, gender).otherwise(out) if gender != "n" else out
    return out


def script_of(entity: Column) -> Column:
    return F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _draw(seed: Column, i: Column | int) -> Column:
    """A number of 0 to 2**31 - 1 from a seed and a place. The seed holds 256 keyed bits already."""
    return F.abs(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i) % F.lit(1 << 31))


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _letters(text: Column, seed: Column) -> Column:
    """Each letter or digit is replaced within its script and case; everything else stays."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for chars, alphabet in ALPHABETS.items():
            out = F.when(c.rlike(f"^[{chars}]$"), F.substring(F.lit(alphabet), (_draw(seed, i) % len(alphabet) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _layout(entity: Column, digits: Column) -> Column:
    """The entity with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    put = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.substring(digits, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))
    return F.aggregate(F.split(entity, ""), start, put)["s"]


def _luhn(digits: Column) -> Column:
    """Sum of a card number's digits, every other one doubled from the right; a multiple of ten if it is valid."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def surrogates(items: Column, key: str, family: Callable[[Column], Column] = lambda s: F.lit(0)) -> Column:
    """The replacements of entities (array of entity, kind, norm, attempt), each in its own layout: a function of the key,
    its normal form, the attempt and, for a name, its surname's attempt, which `family` takes from the item. The kind
    `surname` is a surname alone. Steps hand on what they found, so that nothing is evaluated twice."""
    title = rf"^(?:{_honor})\.? "
    keep = lambda s, *names: [s[x].alias(x) for x in names]
    base = ("entity", "kind", "attempt")

    def seeded(s: Column) -> Column:
        entity = s["entity"]
        words = words_of(entity)
        drawn_in = F.when(s["kind"] == "name", family(s)).otherwise(s["attempt"])
        part = F.when(s["kind"].isin("name", "surname"), F.concat_ws("\x1f", F.lower(F.element_at(words, -1)), drawn_in.cast("string"))).otherwise(F.lower(F.substring_index(entity, "@", -1)))
        return F.struct(*keep(s, *base), drawn_in.alias("drawn_in"), F.sha2(F.concat_ws("\x1f", F.lit(key), s["norm"], s["attempt"].cast("string")), 256).alias("seed"), F.sha2(F.concat_ws("\x1f", F.lit(key), part), 256).alias("part_seed"), F.regexp_replace(entity, "[^0-9]", "").alias("digits"), words.alias("words"))

    def drawn(s: Column) -> Column:
        seed = s["seed"]
        # A card number keeps its first digit.
        each = F.transform(F.split(s["digits"], ""), lambda c, i: F.when((i == 0) & (s["kind"] == "card"), c).when(i == 0, (_draw(seed, i) % 8 + 2).cast("string")).otherwise((_draw(seed, i) % 10).cast("string")))
        # A phone number keeps its country code.
        code = F.regexp_extract(s["entity"], r"^\+([0-9]{1,3})(?=[ .(-])", 1)
        return F.struct(*keep(s, *base, "drawn_in", "seed", "part_seed", "digits", "words"), F.array_join(each, "").alias("drawn"), code.alias("code"))

    def made(s: Column) -> Column:
        entity, kind, seed, part_seed, digits = (s[x] for x in ("entity", "kind", "seed", "part_seed", "drawn"))
        head = F.substring(digits, F.lit(1), F.length(digits) - 1)
        check = ((F.lit(10) - _luhn(F.concat(head, F.lit("0"))) % 10) % 10).cast("string")
        card = F.when(_luhn(s["digits"]) % 10 == 0, F.concat(head, check)).otherwise(digits)
        phone = F.concat(s["code"], F.substring(digits, F.length(s["code"]) + 1, F.length(digits)))
        # A mail address keeps its shape in the first draw; the domain depends on the domain alone.
        host = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.substring(F.lit(ALPHABETS["a-z"]), (_draw(part_seed, i) % 26 + 1).cast("int"), F.lit(1))), "")
        # Each further attempt has one more letter to draw from, so short local parts don't run out; in the end the kinds
        # of a fixed layout get longer, too.
        drawn_from = lambda chars, n: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.lit(chars), (_draw(seed, -i) % len(chars) + 1).cast("int"), F.lit(1))), "")).otherwise("")
        more, last = drawn_from(ALPHABETS["a-z"], s["attempt"]), drawn_from(ALPHABETS["0-9"], s["attempt"] - FIXED)
        mail = F.concat(_letters(F.substring_index(entity, "@", 1), seed), more, F.lit("@"), host, F.lit(".example"))
        ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(seed, i) % 254 + 1).cast("string")), ".")
        iban = F.concat(F.substring(entity, 1, 2), _letters(F.substring(entity, F.lit(3), F.length(entity)), seed))
        lead, bare = F.regexp_extract(entity, f"^{_lead}", 0), F.regexp_replace(entity, f"^{_lead}", "")
        hexes = F.substring(F.concat(seed, F.sha2(seed, 256)), F.lit(1), F.least(F.length(bare), F.lit(128)))
        secret = F.when(bare.startswith("AKIA"), F.concat(F.lit("AKIA"), _letters(F.substring(bare, F.lit(5), F.length(bare)), seed))).when(bare.rlike("^[0-9a-f]{1,128}$"), hexes).otherwise(_letters(bare, seed))
        out = F.when(kind == "ip", ip).when(kind == "card", _layout(entity, card)).when(kind == "phone", _layout(entity, phone)).when(kind == "ssn", _layout(entity, digits)).when(kind == "iban", iban)
        surname = _surname(s["words"], part_seed, s["drawn_in"])
        person = F.concat(F.regexp_extract(entity, title, 0), _person(entity, s["words"], seed, surname, s["attempt"]))
        fixed = F.concat(out.otherwise(F.concat(lead, secret)), F.when((kind == "ip") & (last != ""), ":").otherwise(""), last)
        return F.when(kind == "number", entity).when(kind == "name", person).when(kind == "surname", surname).when(kind == "email", mail).otherwise(fixed)

    return F.transform(F.transform(F.transform(items, seeded), drawn), made)


def _surname(words: Column, seed: Column, attempt: Column) -> Column:
    """A surname made of syllables of the last word's script, whose seed depends on that word (and on its attempt) alone.
    Each further attempt has one more syllable, so surnames don't run out."""
    script, out = script_of(F.element_at(words, -1)), F.lit(None).cast("string")
    for s, parts in SYLLABLES.items():
        made = F.initcap(F.concat(*(_pick(parts, _draw(seed, i)) for i in range(1, 5))))
        more = F.array_join(F.transform(F.sequence(F.lit(5), attempt + 4), lambda i: _pick(parts, _draw(seed, i))), "")  # noqa: B023
        out = F.when(script == s, F.when(attempt > 0, F.concat(made, more)).otherwise(made)).otherwise(out)
    return out


def _person(entity: Column, words: Column, seed: Column, family: Column, attempt: Column) -> Column:
    """A given name of the same gender and script if there is one, and the surname's surrogate, so that Ms Doe and Jane Doe
    keep a name in common. Each further attempt has one more given name (Anna-Maria), so those don't run out, either. A
    surname alone has no second draw, as its own check settles it."""
    gender, script = gender_of(entity), script_of(entity)
    given = F.lit(None).cast("string")
    for s in SYLLABLES:
        both = [x for (s2, _), group in GIVEN.items() if s2 == s for x in group]
        for g, names in (("n", both), *((g, names) for (s2, g), names in GIVEN.items() if s2 == s)):
            drawn = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: _pick(names, _draw(seed, i))), "-")  # noqa: B023
            given = F.when((script == s) & (gender == g), drawn).otherwise(given)
    return F.when(F.size(words) > 1, F.concat(given, F.lit(" "), family)).otherwise(family)


def last_word(name: Column) -> Column:
    return F.regexp_extract(name, r"(\p{L}[\p{L}'’-]+)$", 1)


def bare_surnames(gaps: Column, names: Column) -> Column:
    """Gaps of a text in which the surnames of names (array of entity and made) are replaced where they stand alone, also
    before an apostrophe or a hyphen. Only words as the name has them, capital first, count; a surname that is a common
    word stays where a sentence begins with it. Words are looked up by hash, so the work is linear in the text."""
    pairs = F.array_distinct(F.transform(names, lambda z: F.struct(last_word(z["entity"]).alias("k"), last_word(z["made"]).alias("v"))))
    n = lambda found: F.least(F.lit(BUCKETS), F.size(found))
    hashed = lambda found: F.transform(F.sequence(F.lit(0), n(found) - 1), lambda b: F.filter(found, lambda p: F.pmod(F.xxhash64(p["k"]), n(found)) == b))
    common = F.array(*map(F.lit, COMMON))

    def looked_up(word: Column, known: Column) -> Column:
        bucket = F.get(known, F.pmod(F.xxhash64(word), F.size(known)).cast("int"))
        return F.get(F.filter(bucket, lambda p: p["k"] == word), 0)["v"]

    def replaced(word: Column, known: Column, begins: Column) -> Column:
        tried = [word, F.regexp_replace(word, r"['’]\p{L}$", ""), F.regexp_extract(word, r"^[\p{L}\p{N}]+", 0)]
        found = [F.concat(looked_up(x, known), F.substring(word, F.length(x) + 1, F.length(word))) for x in tried]
        stays = ~word.rlike(r"^\p{Lu}") | (begins & F.array_contains(common, word))
        return F.when(stays, word).otherwise(F.coalesce(*found, word))

    def in_gap(gap: Column, j: Column, known: Column) -> Column:
        words = F.regexp_extract_all(gap, F.lit(r"[\p{L}\p{N}]++(?:['’-]++[\p{L}\p{N}]++)*|[^\p{L}\p{N}]++"), F.lit(0))
        begins = lambda held, i: F.when(i == 0, j == 0).otherwise(F.get(held, i - 1).rlike(r"[.!?…\n][^\p{L}\p{N}]*$"))
        return F.transform(F.array(words), lambda held: F.array_join(F.transform(held, lambda w, i: replaced(w, known, begins(held, i))), ""))[0]

    # Arrays of one element hand on what was found, so that nothing is evaluated for each word again.
    known = F.transform(F.array(pairs), hashed)
    return F.transform(known, lambda k: F.transform(gaps, lambda g, j: in_gap(g, j, k)))[0]


def redraws(entities: DataFrame, key: str) -> DataFrame:
    """norm and attempt (above 0) of the entities (entity, norm, kind, family; one row for each norm) that have to draw
    again.

    Every kind's space grows with the attempts, so the rounds end, however many entities there are.
    """
    waiting = entities.select("entity", "norm", "kind", "family", F.lit(0).alias("attempt"))
    real = entities.select(F.col("norm").alias("taken")).distinct()
    settled, out = None, None
    while True:
        item = F.array(F.struct("entity", "kind", "norm", "attempt", "family"))
        drawn = cut(waiting.withColumn("made", surrogates(item, key, lambda s: s["family"])[0])).withColumn("made", normal(F.col("made"), F.col("kind")))
        first = drawn.groupBy("made").agg(F.min("norm").alias("winner"), F.count("*").alias("n"))
        bad = first.where("n > 1").select("made", "winner").join(drawn, "made").where("norm <> winner").select("norm")
        bad = bad.union(drawn.join(real, drawn["made"] == real["taken"], "left_semi").select("norm"))
        if settled is not None:
            bad = bad.union(drawn.join(settled, "made", "left_semi").select("norm"))
        bad = cut(bad.distinct())
        if settled is None:
            settled = cut(drawn.join(bad, "norm", "left_anti").select("made"))
        else:
            done = cut(drawn.join(bad, "norm", "left_anti").select("norm", "attempt", "made"))
            settled = cut(settled.union(done.select("made")))
            out = done.select("norm", "attempt") if out is None else cut(out.union(done.select("norm", "attempt")))
        if not bad.limit(1).count():
            break
        waiting = cut(waiting.join(bad, "norm", "left_semi").withColumn("attempt", F.col("attempt") + 1))
    return out if out is not None else waiting.select("norm", "attempt").limit(0)


def all_redraws(entities: DataFrame, key: str) -> DataFrame:
    """As redraws(), for entities without family: surnames and all kinds but names draw first, then names, whose surnames
    stand by then. The surnames' norms are among the result."""
    plain = entities.where("kind <> 'name'").select("entity", "norm", "kind")
    names = entities.where("kind = 'name'").withColumn("surname", surname_of(F.col("entity"), F.col("kind")))
    surnames = names.groupBy(F.col("surname").alias("norm")).agg(F.min(F.element_at(words_of(F.col("entity")), -1)).alias("entity"))
    first = redraws(cut(plain.unionByName(surnames.withColumn("kind", F.lit("surname"))).withColumn("family", F.lit(0))), key)
    family = first.select(F.col("norm").alias("surname"), F.col("attempt").alias("family"))
    names = names.join(family, "surname", "left").withColumn("family", F.coalesce("family", F.lit(0)))
    return cut(first.unionByName(redraws(cut(names), key)))


def replace_entities(df: DataFrame, key: str, text: str = "text", found: str = "n_entities") -> DataFrame:
    """Replace the entities of whole texts by surrogates under a secret key and add their number; other columns are kept.

    Null texts stay null with no entities, texts without entities stay as they are. Equal entities, also of repeated
    rows, get equal surrogates; an empty table stays empty; where a column has the name `found`, the number's gets
    another. A surname that a name in a text ends in is replaced in the rest of the text, too
    (see bare_surnames()); titles stay. Texts of any length are taken whole, with any number of names. Surrogates
    get longer where a kind's space runs out.

    The patterns run over each text once: rows are written with what was found in them to the shared folder, and read
    again. Texts aren't shuffled: only the few entities that collide in their first draw are brought to the texts that
    hold them (in a broadcast, if their counted size allows).
    """
    spot, again = free_name(df, "entity_list"), free_name(df, "redraw_map")
    body = F.coalesce(F.col(text), F.lit(""))
    items = F.transform(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), lambda x: F.struct(x.alias("entity"), kind_of(x).alias("kind")))
    items = F.transform(items, lambda s: F.struct(s["entity"].alias("entity"), s["kind"].alias("kind"), normal(s["entity"], s["kind"]).alias("norm")))
    out = stored(df.withColumn(spot, items))
    each = out.select(F.explode(spot).alias("s")).where("s.kind <> 'number'").select("s.*")
    odd = all_redraws(cut(each.groupBy("norm", "kind").agg(F.min("entity").alias("entity"))), key)
    n = odd.count()
    if n:
        hold = free_name(df, "text_hash")
        own = F.array_union(F.col(spot)["norm"], F.array_compact(F.transform(spot, lambda s: surname_of(s["entity"], s["kind"]))))
        few = out.where(F.size(spot) > 0).select(F.sha2(body, 256).alias(hold), F.explode(own).alias("norm"))
        few = few.join(F.broadcast(odd) if n * 100 <= BROADCAST_BYTES else odd, "norm").select(hold, "norm", "attempt").distinct()
        few = cut(few.groupBy(hold).agg(F.map_from_entries(F.collect_list(F.struct("norm", "attempt"))).alias(again)))
        few = F.broadcast(few) if few.count() * 300 <= BROADCAST_BYTES else few
        out = out.withColumn(hold, F.sha2(body, 256)).join(few, hold, "left").drop(hold)
        attempt = lambda norm: F.coalesce(F.element_at(F.col(again), norm), F.lit(0))
    else:
        out, attempt = out.withColumn(again, F.lit(0)), lambda norm: F.lit(0)
    tried = F.transform(F.col(spot), lambda s: F.struct(s["entity"].alias("entity"), s["kind"].alias("kind"), s["norm"].alias("norm"), attempt(s["norm"]).alias("attempt"), F.when(s["kind"] == "name", attempt(surname_of(s["entity"], s["kind"]))).otherwise(0).alias("family")))
    made = free_name(df, "surrogate_list")
    out = out.withColumn(made, F.when(F.size(spot) > 0, surrogates(tried, key, lambda s: s["family"])))
    gaps = F.split(F.col(text), ANY, -1)
    # Bare surnames: the last word of each name, as a whole word of the gaps.
    names = F.filter(F.arrays_zip(F.col(spot)["entity"].alias("entity"), F.col(spot)["kind"].alias("kind"), F.col(made).alias("made")), lambda z: (z["kind"] == "name") & (last_word(z["entity"]) != ""))
    named = F.exists(spot, lambda s: (s["kind"] == "name") & (last_word(s["entity"]) != ""))
    gaps = F.when(named, bare_surnames(gaps, names)).otherwise(gaps)
    woven = F.array_join(F.flatten(F.zip_with(gaps, F.col(made), lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
    out = out.withColumn(free_name(df, found), F.size(F.filter(spot, lambda s: s["kind"] != "number")))
    return out.withColumn(text, F.when(F.size(spot) > 0, woven).otherwise(F.col(text))).drop(spot, again, made)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates under the session's key; set one before using the texts."""
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, OPEN_KEY))
