"""Secret scans through a trigram index: Boolean trigram queries name the rules worth running on a text."""

from __future__ import annotations

from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import named, pieces, running, values, written_table

# Kind, pattern, group that carries the secret, least length of that group.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
]
BASE = ("assign", "access", "hex")

#: Patterns that need no matches below the least length, with the same spans: a run is cut nowhere.
_LONG = {"hex": r"(?<![0-9a-f])[0-9a-f]{24,}+", "access": r"AKIA[A-Z0-9]{16,}+"}

_GAP = "\n"


def trigram_query(pattern: str, most: int = 64) -> list[set[str]]:
    """A Boolean query a text must meet to match `pattern`: any of the returned sets, wholly.

    Walks the parsed pattern and spells out its mandatory literals, branching over alternatives,
    optional letters and small classes; whatever is open ends a literal. Lower case throughout, since
    the index is over lower-cased text. An empty list: some match needs no trigram, scan everything.
    """

    def spell(nodes) -> list[str]:
        forms = [""]
        for kind, arg in nodes:
            if kind == op.LITERAL:
                ends = [chr(arg).lower()]
            elif kind == op.IN:
                one = {chr(v).lower() for k, v in arg if k == op.LITERAL}
                ends = sorted(one) if len(one) <= 4 and all(k == op.LITERAL for k, _ in arg) else [_GAP]
            elif kind == op.SUBPATTERN:
                ends = spell(arg[-1])
            elif kind == op.BRANCH:
                ends = [form for branch in arg[1] for form in spell(branch)]
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
                least, greatest, inner = arg
                ends = spell(inner)
                if least == 0:
                    ends = ["", *ends] if greatest == 1 else [_GAP]
                elif greatest > 1:
                    ends = [form + _GAP for form in ends]
            elif kind == op.AT:
                ends = [""]
            else:
                ends = [_GAP]
            forms = [a + b for a in forms for b in ends]
            if len(forms) > most:
                forms = [_GAP]
        return forms

    found = []
    for form in spell(_parser.parse(pattern)):
        grams = {run[i : i + 3] for run in form.split(_GAP) for i in range(len(run) - 2)}
        if not grams:
            return []
        found.append(grams)
    # A set that contains another one adds nothing.
    return [g for i, g in enumerate(found) if not any(o < g or (o == g and j < i) for j, o in enumerate(found))]


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index `gram, doc_id` for the trigrams that the rules ask for."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc_id", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """Intersect postings: `doc_id, kinds` (names of rules whose query the document meets)."""
    rows = [
        (kind, i, gram, len(grams))
        for kind, pattern, *_ in rules for i, grams in enumerate(trigram_query(pattern)) for gram in sorted(grams)
    ]
    spark = docs.sparkSession
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, kinds array<string>")
    wanted = values(spark, ["kind", "alt", "gram", "needed"], rows)
    index = postings(docs, sorted({r[2] for r in rows}))
    # Rows of one doc_id share their postings: that can only add candidates, which are verified.
    met = index.distinct().join(F.broadcast(wanted), "gram").groupBy("doc_id", "kind", "alt", "needed").count()
    return met.where("count = needed").groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _matches(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Lengths in code points: of the text between a rule's matches, of the matches, of their secrets."""
    pattern = _LONG.get(kind, pattern)
    gaps, found = pieces(text, pattern)
    lengths = lambda parts: F.transform(parts, lambda p: F.length(p))
    secret = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return F.struct(
        F.lit(order).alias("rank"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), lengths(gaps).alias("gaps"),
        lengths(found).alias("found"), secret.alias("secret"),
    )


def _spans(rule: Column) -> Column:
    """Spans `start, rank, end, kind` of one rule's matches: running totals of what lies before them."""
    steps = F.zip_with(F.slice(rule["gaps"], F.lit(1), F.size(rule["found"])), rule["found"], lambda a, b: a + b)
    ends = running(steps, F.lit(0), lambda a, x: a + x)
    every = F.arrays_zip(ends.alias("e"), rule["found"].alias("n"), rule["secret"].alias("s"))
    long = F.filter(every, lambda x: x["s"] >= rule["least"])
    return F.transform(
        long, lambda x: F.struct((x["e"] - x["n"]).alias("start"), rule["rank"].alias("rank"), x["e"].alias("end"), rule["kind"].alias("kind"))
    )


def find(docs: DataFrame, rules=RULES) -> DataFrame:
    """Add `spans` (sorted array of `start, rank, end, kind`) to every row of `docs`.

    Rules with mandatory trigrams run only on documents whose postings meet their query; the others
    scan every text. The candidates are a written table of ids, so that Spark joins by its measured size: small ones are
    broadcast by the session's own threshold, otherwise both sides shuffle on doc_id. Spans of a rule are
    leftmost and do not overlap; matches whose secret is too short are dropped after matching.
    Null text counts as empty. Null doc_ids match null doc_ids. Input columns stay as they are, one
    output row per input row.
    """
    open_rules = [r for r in rules if not trigram_query(r[1])]
    found = written_table(candidates(docs.select("doc_id", "text"), rules), "secret-candidates")
    held = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("doc"))
    found = found.select(F.col("doc_id").alias("found_id"), "kinds")
    both = held.join(found, F.col("doc.doc_id").eqNullSafe(F.col("found_id")), "left")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    parts = []
    for order, rule in enumerate(rules):
        kind, pattern = rule[0], rule[1]
        due = text.rlike(_LONG.get(kind, pattern))
        if rule not in open_rules:
            due = F.coalesce(F.array_contains("kinds", kind), F.lit(False)) & due
        parts.append(F.when(due, _matches(text, kind, order, *rule[1:])))
    matched = both.select("doc", F.array_compact(F.array(*parts)).alias("matched"))
    spans = F.array_sort(F.flatten(F.transform("matched", _spans)))
    return matched.select("doc", spans.alias("spans")).select("doc.*", "spans")


def digest(found: DataFrame, rules=RULES) -> DataFrame:
    """Counts and span lists of `find`: `doc_id, n_assign, n_access, n_hex, base_sha256, spans`."""
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """Put `[SECRET]` in the place of every secret found; rows and columns stay.

    Overlapping spans are masked as one. `n_chars`, where present, follows the new text. Texts without
    secrets (null and empty ones too) stay as they are.
    """
    columns = docs.columns
    spare = next(n for n in ("spans", *(f"spans{i}" for i in range(len(columns) + 1))) if n not in columns)
    held = docs.select("doc_id", "text", F.struct(*[named(c) for c in columns]).alias("held"))
    found = find(held, rules).withColumnRenamed("spans", spare)
    ends = F.transform(spare, lambda s: s["end"])
    found = found.select("text", "held", F.col(spare).alias("cut"), running(ends, F.lit(0), lambda a, x: F.greatest(a, x)).alias("reach"))

    def masked_piece(span: Column, i: Column) -> Column:
        """The text between the spans so far and this one, then the mask; nothing inside an earlier span."""
        past = F.coalesce(F.get("reach", i - 1), F.lit(0))
        own = F.concat(F.substring(F.col("text"), past + 1, span["start"] - past), F.lit("[SECRET]"))
        return F.when((i == 0) | (span["start"] > past), own).otherwise(F.lit(""))

    rest = F.substring(F.col("text"), F.element_at("reach", -1) + 1, F.length("text"))
    masked = F.when(F.size("cut") > 0, F.concat(F.array_join(F.transform("cut", masked_piece), ""), rest))
    found = found.select("held", F.coalesce(masked, F.col("text")).alias("masked"), (F.size("cut") > 0).alias("changed"))
    out = []
    for c in columns:
        own = F.col("held").getField(c)
        if c == "text":
            own = F.col("masked")
        elif c == "n_chars":
            own = F.when(F.col("changed"), F.length("masked").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return found.select(*out)
