"""Surrogates for personal data: keyed, of the same type, script and format, and distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import let, named, pieces, written_table

# Titles before a person's name.
TITLES = ["Mrs", "Mr", "Ms", "Miss", "Herr", "Frau", "Madame", "Monsieur", "Señora", "Señor", "Господин", "Госпожа"]

# Kinds of entities and their shapes, in order of preference at one place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*(?<=\.\p{L}{2,24})",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![\p{L}\p{N}-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9-]))",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "person": rf"(?<!\p{{L}})(?:{'|'.join(TITLES)})\.?+ \p{{Lu}}[\p{{L}}'’-]++(?: \p{{Lu}}[\p{{L}}'’-]++)?",
}


def any_kind() -> str:
    """The joint pattern, in the order of KINDS at every place, without trying each shape at each character.

    Shapes of digits start at a digit, a plus sign or a bracket, names and account numbers never do, and no shape that
    starts otherwise follows a letter: one look at the two characters there leaves out all other shapes.
    """
    titles = "(?=[" + "".join(sorted({t[0] for t in TITLES})) + "])"
    digits = "|".join(KINDS[k] for k in ("email", "phone", "ip", "ssn", "card"))
    words = "|".join((KINDS["email"], "(?=[A-Z])" + KINDS["iban"], titles + KINDS["person"]))
    return rf"(?=[0-9+(])(?:{digits})|(?<!\p{{L}})(?![0-9+(])(?:{words})"


ANY = any_kind()

# Titles that tell a woman, and given names and syllables by gender and script.
WOMAN = r"^(?:Mrs|Ms|Miss|Frau|Madame|Señora|Госпожа)"
NAMES = {
    ("latin", True): ["Anna", "Clara", "Diana", "Elena", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sofia", "Vera"],
    ("latin", False): ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Robert", "Simon"],
    ("cyrillic", True): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Ксения", "Мария", "Ольга"],
    ("cyrillic", False): ["Антон", "Борис", "Денис", "Игорь", "Максим", "Олег", "Павел", "Роман"],
}
SYLLABLES = {
    "latin": ["ba", "del", "fen", "gor", "hal", "kin", "lam", "mer", "nol", "per", "ras", "sel", "tor", "ven", "wil", "zan"],
    "cyrillic": ["бар", "вел", "гор", "дан", "жил", "зор", "кал", "лин", "мир", "нев", "пол", "рад", "сом", "тар", "фед", "чер"],
}

#: Digest blocks that letters and digits are drawn from (32 draws each), and rounds of collision checks.
BLOCKS, ROUNDS = 4, 24


def kind_of(value: Column) -> Column:
    """Which shape an entity has; the same order as in the joint pattern."""
    out = F.lit(None).cast("string")
    for kind, shape in reversed(KINDS.items()):
        out = F.when(value.rlike("^(?:" + shape + ")$"), F.lit(kind)).otherwise(out)
    return out


# A word of a name, and what of it is no part of the name.
_WORD, _TAIL = r"(?<!\p{L})\p{Lu}[\p{L}'’-]*+", r"(?:['’]s|['’-]+)$"


def canonical(kind: Column, value: Column) -> Column:
    """What one entity's notations have in common: letters in lower case, digits, for numbers only those."""
    marks = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("email", "ip"), F.lower(value)).when(kind.isin("person", "given"), bare_name(value)).otherwise(marks)


def bare_name(word: Column) -> Column:
    """A name in lower case, without a genitive's ending."""
    return F.lower(F.regexp_replace(word, _TAIL, ""))


def parts_of(value: Column) -> Column:
    """The entities in one match, each with the text before it: `lead, kind, value`.

    A person is a surname (kind `person`) and, where there is one, a given name (kind `given`, after the gender that the title tells),
    so that all mentions of a surname share its surrogate, whether a given name stands by it or not.
    """
    words = F.split(value, " ")
    lead = F.concat(F.get(words, F.lit(0)), F.lit(" "))
    gender = F.when(value.rlike(WOMAN), "f:").otherwise("m:")
    entity = lambda lead, kind, text: F.struct(lead.alias("lead"), kind.alias("kind"), text.alias("value"))
    last = F.element_at(words, -1)
    person = F.when(
        F.size(words) > 2, F.array(entity(lead, F.lit("given"), F.concat(gender, F.get(words, F.lit(1)))), entity(F.lit(" "), F.lit("person"), last))
    ).otherwise(F.array(entity(lead, F.lit("person"), last)))
    return let(kind_of(value), lambda kind: F.when(kind == "person", person).otherwise(F.array(entity(F.lit(""), kind, value))))


def draws_of(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Hex text that key, entity and attempt determine; two digits a draw."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(BLOCKS)])


def _draw(draws: Column, i: Column | int, below: Column | int) -> Column:
    at = F.pmod((F.lit(i) if isinstance(i, int) else i), F.lit(32 * BLOCKS)) * 2 + 1
    return F.pmod(F.conv(F.substring(draws, at, F.lit(2)), 16, 10).cast("int"), F.lit(below) if isinstance(below, int) else below)


_ALPHABETS = (  # first letter and number of letters of the scripts that are kept
    ("0", "9"), ("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω"),
)
_BLOCKS = (  # first and last code of further letters, and the letters drawn for them
    (0x370, 0x3FF, "α", "ρ"), (0x400, 0x52F, "а", "я"), (0x531, 0x58F, "ա", "ֆ"), (0x590, 0x5FF, "א", "ת"), (0x600, 0x6FF, "ا", "غ"),
    (0x900, 0x97F, "क", "ह"), (0xE00, 0xE7F, "ก", "ฮ"), (0x10D0, 0x10FF, "ა", "ჰ"), (0x3040, 0x309F, "ぁ", "ん"), (0x30A0, 0x30FF, "ァ", "ン"),
    (0x3400, 0x9FFF, "一", "仿"), (0xAC00, 0xD7A3, "가", "곿"),
)


def _alike(value: Column, draws: Column, fixed: Column) -> Column:
    """Every letter and digit after the first `fixed` characters replaced within its script and case.

    Letters of a script that has no letters here become Latin ones, and other digits ASCII ones.
    """

    def one(c: Column, i: Column) -> Column:
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(draws, i, 26) + 1, F.lit(1))
        code = F.ascii(c)
        pool, start, n = "abcdefghijklmnopqrstuvwxyz", F.lit(0), F.lit(26)
        for low, high, first, last in _BLOCKS:
            start = F.when(code.between(low, high), len(pool)).otherwise(start)
            n = F.when(code.between(low, high), ord(last) - ord(first) + 1).otherwise(n)
            pool += "".join(map(chr, range(ord(first), ord(last) + 1)))
        out = F.substring(F.lit(pool), start + _draw(draws, i, n) + 1, F.lit(1))
        out = F.when(c.rlike(r"^\p{L}"), out).when(c.rlike(r"^\p{N}"), _draw(draws, i, 10).cast("string")).otherwise(c)
        out = F.when(code < 0x80, c).otherwise(out)
        for first, last in _ALPHABETS:
            n = ord(last) - ord(first) + 1
            drawn = F.substring(F.lit("".join(chr(ord(first) + k) for k in range(n))), _draw(draws, i, n) + 1, F.lit(1))
            out = F.when((code >= ord(first)) & (code <= ord(last)), drawn).otherwise(out)
        latin = F.when(code.between(0xC0, 0x24F), F.when(c == F.upper(c), F.upper(letter)).otherwise(letter)).otherwise(out)
        return F.when(i < fixed, c).otherwise(latin)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def surrogate(kind: Column, value: Column, draws: Column, attempt: Column) -> Column:
    """The replacement of one notation of an entity.

    Drawn digits and letters stand by the entity's own letters and digits, so that other separators give the
    same replacement in the other notation. A phone keeps its country code, an e-mail its top domain, a name its
    script, a given name the gender told by the title; an IP's numbers stay below 256. A name gets one more syllable
    with each attempt, an e-mail's domain one more letter and a phone one more digit with each attempt after the third,
    so that the space grows until all replacements are distinct.
    """
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    code = F.length(F.regexp_extract(value, r"^\+([0-9]{1,3}?)(?=[ .(-])", 1))
    moved = _alike(bare, draws, F.when(kind == "phone", code).when(kind == "iban", 2).otherwise(0))
    # Put the drawn characters back between the separators, each gap where it was.
    gaps = F.split(value, r"[\p{L}\p{N}]", -1)
    numbers = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(F.split(moved, ""), lambda c, i: F.concat(c, F.get(gaps, i + 1))), ""))
    top = F.regexp_extract(value, r"\.\p{L}+$", 0)
    more = lambda to: F.substring(F.translate(draws, "0123456789abcdef", to), F.lit(64 * BLOCKS - 63), F.greatest(attempt - 3, F.lit(0)))
    numbers = F.when(kind == "phone", F.concat(numbers, more("0123456789012345"))).otherwise(numbers)
    mail = F.concat(_alike(F.substring(F.lower(value), F.lit(1), F.length(value) - F.length(top)), draws, F.lit(0)), more("abcdefghijklmnop"), top)
    address = F.concat_ws(".", *[(_draw(draws, i, 254) + 1).cast("string") for i in range(4)])
    own = F.when(kind == "given", F.substring(value, F.lit(3), F.length(value))).otherwise(value)
    tail = F.regexp_extract(own, _TAIL, 0)

    def syllables(script: str, n: Column) -> Column:
        pool = F.array(*map(F.lit, SYLLABLES[script]))
        every = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i > 0, F.element_at(pool, _draw(draws, i, len(SYLLABLES[script])) + 1)).otherwise(""))
        return F.array_join(every, "")

    def name(script: str) -> Column:
        given = lambda w: F.element_at(F.array(*map(F.lit, NAMES[script, w])), _draw(draws, 0, len(NAMES[script, w])) + 1)
        first = F.concat(F.when(value.startswith("f:"), given(True)).otherwise(given(False)), syllables(script, attempt))
        return F.when(kind == "given", first).otherwise(F.initcap(syllables(script, attempt + 4)))

    name_of = F.when(own.rlike(r"\p{IsCyrillic}"), name("cyrillic")).otherwise(name("latin"))
    name_of = F.concat(F.when((F.length(own) > 1) & (own == F.upper(own)), F.upper(name_of)).otherwise(name_of), tail)
    return F.when(kind == "email", mail).when(kind == "ip", address).when(kind.isin("person", "given"), name_of).otherwise(numbers)


def entities(docs: DataFrame) -> DataFrame:
    """Every entity in the texts: `doc_id, kind, value, canon`, repeats included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("value"))
    found = found.select("doc_id", F.explode(parts_of(F.col("value"))).alias("e")).select("doc_id", "e.kind", "e.value")
    return found.withColumn("canon", canonical(F.col("kind"), F.col("value")))


def attempts(found: DataFrame, key: str) -> DataFrame:
    """Entities whose first draw will not do: `kind, canon, attempt`.

    A replacement collides when another entity of its kind has it, or when it is itself an entity of
    the corpus. Colliding entities draw again, the first of a group (by canonical form) keeps its
    draw, until none collides. The work is on distinct entities, grouped by replacement.
    """
    every = written_table(found.groupBy("kind", "canon").agg(F.min("value").alias("value")), "entities")
    again = None
    for turn in range(ROUNDS):
        tries = F.coalesce(F.col("attempt"), F.lit(0)) if again is not None else F.lit(0)
        state = every if again is None else every.join(again, ["kind", "canon"], "left")
        drawn = state.select("kind", "canon", "value", tries.alias("attempt"))
        drawn = drawn.withColumn("draws", draws_of(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        drawn = drawn.withColumn("new", surrogate(F.col("kind"), F.col("value"), F.col("draws"), F.col("attempt")))
        gender = F.when(F.col("kind") == "given", F.substring("value", 1, 2)).otherwise("")
        drawn = drawn.select("kind", "canon", "attempt", canonical(F.col("kind"), F.concat(gender, "new")).alias("new"))
        known = every.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
        same = Window.partitionBy("kind", "new").orderBy("canon")
        drawn = drawn.withColumn("later", F.row_number().over(same) > 1)
        drawn = drawn.join(known, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("c")), "left")
        clash = F.col("later") | F.col("c").isNotNull()
        moved = drawn.where(clash | (F.col("attempt") > 0)).select(
            "kind", "canon", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")
        )
        moved = written_table(moved, "attempts")
        again = moved.select("kind", "canon", "attempt")
        if not moved.where("clash").limit(1).count():
            return again
    raise ValueError("no distinct replacements found; the shapes of the entities leave too few")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """Replace the personal data in `text`; every row and column stays, `n_entities` is added.

    The same entity gets the same replacement everywhere, different ones get different ones, and no replacement is an
    entity that the corpus holds. A person is a title with one or two names; where these names stand again in the same document, each
    alone and without a title, they are replaced, too (a word with a capital, in any case after it; not counted). Replacements are computed where the text is; only the few entities that
    had to draw again are looked up, by a join on doc_id whose small side Spark broadcasts by
    its measured size or else shuffles. Null and empty texts stay. Rows with equal or null doc_id share their lookups. An
    input column `n_entities` is replaced.
    """
    found = written_table(entities(docs.select("doc_id", "text")).distinct(), "found")
    again = attempts(found, key)
    held = docs.select(F.struct(*[named(c) for c in docs.columns if c != "n_entities"]).alias("doc"))
    due = found.join(again, ["kind", "canon"]).select("doc_id", F.concat_ws("\x1f", "kind", "canon").alias("e"), "attempt")
    due = due.distinct().groupBy(F.col("doc_id").alias("of_id")).agg(F.map_from_entries(F.collect_list(F.struct("e", "attempt"))).alias("again"))
    due = written_table(due, "again-by-document")
    both = held.join(due, F.col("doc.doc_id").eqNullSafe(F.col("of_id")), "left")
    text = F.col("doc.text")
    gaps, values = pieces(text, ANY)

    def new(items: Column) -> Column:
        """One step at a time, so that each is evaluated once an entity: `gap, lead, new, name, renamed`."""
        step = lambda own, **more: F.struct(*own, *[c.alias(n) for n, c in more.items()])
        kept = lambda e: [e["gap"], e["lead"], e["kind"], e["value"]]
        held = F.transform(items, lambda e: step(kept(e), canon=canonical(e["kind"], e["value"])))
        tried = lambda e: F.coalesce(F.try_element_at("again", F.concat_ws("\x1f", e["kind"], e["canon"])), F.lit(0))
        held = F.transform(held, lambda e: step([*kept(e), e["canon"]], attempt=tried(e)))
        held = F.transform(held, lambda e: step([*kept(e), e["canon"], e["attempt"]], draws=draws_of(e["kind"], e["canon"], e["attempt"], key)))
        put = lambda e: F.coalesce(surrogate(e["kind"], e["value"], e["draws"], e["attempt"]), e["value"])
        held = F.transform(held, lambda e: step([e["gap"], e["lead"], e["kind"], e["canon"]], new=put(e)))
        word = lambda e: F.when(e["kind"] == "given", F.substring(e["canon"], F.lit(3), F.length(e["canon"]))).otherwise(e["canon"])
        name = lambda e: F.concat(word(e), F.lit("\x1f"), F.initcap(bare_name(e["new"])))
        named_one = lambda e: F.when(e["kind"].isin("person", "given"), name(e)).otherwise(F.lit(None).cast("string"))
        return F.transform(held, lambda e: step([e["gap"], e["lead"], e["new"], e["kind"]], renamed=named_one(e)))

    def untitled(gap: Column) -> Column:
        """The text between entities with the document's names replaced."""
        between, words = pieces(gap, _WORD)

        def other(word: Column) -> Column:
            at = F.array_position("names", bare_name(word))
            renamed = F.get("renamed", (at - 1).cast("int"))
            renamed = F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(renamed)).otherwise(renamed)
            return F.when(at > 0, F.concat(renamed, F.regexp_extract(word, _TAIL, 0))).otherwise(word)

        swapped = F.zip_with(between, F.concat(F.transform(words, other), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        return F.when(F.size("names") > 0, F.array_join(swapped, "")).otherwise(gap)

    def items(gap: Column, value: Column) -> Column:
        """The entities of a match, the first after the text before the match."""
        gap_of = lambda i: F.when(i == 0, gap).otherwise("")
        return F.transform(parts_of(value), lambda e, i: F.struct(gap_of(i).alias("gap"), e["lead"], e["kind"], e["value"]))

    has = F.coalesce(text.rlike(ANY), F.lit(False))
    both = both.select("doc", "again", F.when(has, gaps).alias("gaps"), F.when(has, values).alias("values"))
    before = F.slice("gaps", F.lit(1), F.size("values"))
    both = both.select(
        "doc", "again", F.element_at("gaps", -1).alias("rest"), F.coalesce(F.size("values"), F.lit(0)).cast("long").alias("n_entities"),
        F.flatten(F.zip_with(before, "values", items)).alias("items"),
    )
    both = both.select("doc", "rest", "n_entities", new(F.col("items")).alias("items"))
    # Surnames first: a word that is a given name as well is read as one.
    of = lambda kind: F.transform(F.filter("items", lambda e: e["kind"] == kind), lambda e: e["renamed"])
    both = both.withColumn("pairs", F.array_distinct(F.concat(of("person"), of("given"))))
    both = both.withColumn("names", F.transform("pairs", lambda p: F.substring_index(p, "\x1f", 1)))
    both = both.withColumn("renamed", F.transform("pairs", lambda p: F.substring_index(p, "\x1f", -1)))
    put = F.array_join(F.transform("items", lambda e: F.concat(untitled(e["gap"]), e["lead"], e["new"])), "")
    put = F.concat(put, untitled(F.col("rest")))
    both = both.select("doc", F.coalesce(put, F.col("doc.text")).alias("new_text"), "n_entities")
    out = [F.col("new_text").alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns if c != "n_entities"]
    return both.select(*out, F.greatest("n_entities", F.lit(0)).alias("n_entities"))
