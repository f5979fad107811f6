"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidates are matches of five patterns (``email, ip, card, phone, person``; ``card`` is any chain
of nine or more digits). Five labelers vote yes, no or abstain on each: a regular-expression and
check-digit labeler (it also knows several valid cards in a row, which fail the base check, and what
follows a name; other capitalised words it takes for none, unless the gazetteer lists them), a gazetteer, the words before it, its shape, its neighbours. Expectation
maximisation over the counts of vote patterns (at most 5 * 3**5 rows, whatever the input) gives
each labeler's reliability per kind and a probability per pattern. These probabilities train the
classifier, a naive Bayes model over categories of the span and its surroundings, from sums per
category. Base spans (valid emails, addresses, cards, phones) always stay; the classifier adds
other digit chains (``number``) and names (``person``). Only column expressions and aggregates
touch the rows.

Patterns begin only where a run of their first class begins or the last match ended and never go
back, so long texts take linear time.

Defined results: null text is empty and has no spans; ties and repeated rows get equal results;
extra columns stay untouched; an empty table gives no rows. Spans are code points, end exclusive.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import let, written

BASE = ("email", "ip", "card", "phone")
ADDED = {"card": "number", "person": "person"}  # what the classifier calls spans that fail the base checks
CAPITALISED = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){8,}+",  # shorter chains are neither base nor candidates
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "person": rf"{CAPITALISED}(?: {CAPITALISED})++",
}
HINTS = {"email": "@", "phone": "+"}  # a text without it has no match
LABELERS = ("regex", "gazetteer", "context", "shape", "border")
FEATURES = (*LABELERS, "before", "after", "size")
BEFORE, AFTER = 24, 12
#: Share of true spans expected among candidates; capitalised words are seldom names.
SHARE = {"email": 0.5, "ip": 0.5, "card": 0.5, "phone": 0.5, "person": 0.2}

# Gazetteers and context words (fixed values, lower case).
GIVEN_NAMES = (
    "alice andrea anna antonio carlos charles claire daniel david elena emma eva frank george hans heinrich helen isabel jack jacques james jan jean "
    "john jose juan julia karl kate laura lisa louis lucas luis maria marie martin mary michael miguel monika nicolas olivia oliver paul pedro peter "
    "philippe pierre rafael robert rosa sara sarah sofia sophie stefan susan sven thomas ursula walter william wolfgang"
).split()
DOMAINS = "com org net edu gov io info biz de fr es uk eu us ca ch at it nl be pt mx ar br".split()
CONTEXT = {
    "email": "mail|contact|contacto|kontakt|write|adresse",
    "ip": r"\bip\b|address|host|server|login|adresse",
    "card": r"card|visa|ssn|passport|account|konto|carte|tarjeta|iban|phone|tel\b|call|id\b",
    "phone": "phone|tel|call|fax|mobil|contact",
    "person": r"\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|señor|señora|name is|called|dear|by)\b\.?",
}
NAMED = r"^(?:\s*<|,? (?:born|said|says|wrote|writes|lives|works|phd|jr)\b)"  # what follows a name
LABEL = r"[:=#(]\s?$"  # what comes before a value
AGAINST = r"version|isbn|order|total|price|page|license|chapter|[$€£#]\s*$"


def running_sum(values: Column) -> Column:
    """Sums of the elements before each one: within blocks of 128 and over blocks, so that long arrays stay cheap."""
    size = 128

    def scan(xs: Column, first: Column) -> Column:
        start = F.struct(first.cast("long").alias("t"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(xs, start, lambda s, x: F.struct((s["t"] + x).alias("t"), F.array_append(s["out"], s["t"]).alias("out")), lambda s: s["out"])

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda b: F.slice(xs, b * size + 1, size))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), scan)))

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<long>")).otherwise(whole(xs)))


def luhn(digits: Column) -> Column:
    doubled = lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))
    places = F.transform(F.split(F.reverse(digits), ""), lambda x: x.cast("int"))
    return F.aggregate(F.transform(places, doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def row_of_cards(chain: Column) -> Column:
    """Is a chain of more than 19 digits several valid cards one after the other, cut at its separators?

    Groups are joined from the left until they are a card; each card ends where the first one can.
    """

    def add(state: Column, group: Column) -> Column:
        open_ = F.left(F.concat(state["open"], group), F.lit(20))
        card = F.when(F.length(open_).between(14, 19), luhn(open_)).otherwise(F.lit(False))
        return F.struct(F.when(card, F.lit("")).otherwise(open_).alias("open"))

    joined = F.aggregate(F.split(chain, "[ -]"), F.struct(F.lit("").alias("open")), add, lambda s: s["open"] == "")
    return F.when(F.length(F.regexp_replace(chain, "[^0-9]", "")) > 19, joined).otherwise(F.lit(False))


def valid(kind: str, match: Column) -> Column:
    """Base check of a match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)$"))
    if kind == "person":
        return F.lit(False)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("y")).when(no, F.lit("n")).otherwise(F.lit("-"))


def signals(kind: str, match: Column, left: Column, right: Column, good: Column) -> dict[str, Column]:
    """The labelers' votes and the classifier's categories of one candidate."""
    never, before, after = F.lit(False), F.right(left, F.lit(1)), F.left(right, F.lit(1))
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    first = F.lower(F.split(match, " ")[0])
    cards = row_of_cards(match) if kind == "card" else never
    gazetteer = {
        "email": vote(F.lower(F.regexp_extract(match, r"\.([A-Za-z]+)$", 1)).isin(DOMAINS), ~match.rlike(r"\.[A-Za-z]{2,}$")),
        "ip": vote(never, match.rlike(r"^(?:0|127|255)\.")),
        "card": vote((good | cards) & match.rlike("^[3-6]"), never),
        "phone": vote(match.rlike(r"^\+(?:1|33|34|44|49|52)(?![0-9]{14})"), match.rlike(r"^\+0")),
        "person": vote(first.isin(GIVEN_NAMES), ~first.isin(GIVEN_NAMES)),
    }[kind]
    shape = {
        "email": vote(F.length(match) <= 64, F.length(match) > 254),
        "ip": vote(match.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), match.rlike(r"[0-9]{4}|\.0[0-9]")),
        "card": vote(match.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}|(?:[0-9]{4}[ -]){3}[0-9]{4})$"), (digits > 19) & ~cards),
        "phone": vote(digits.between(10, 13), ~digits.between(8, 15)),
        "person": vote(F.size(F.split(match, " ")).between(2, 3) & (F.length(match) <= 40), F.size(F.split(match, " ")) > 4),
    }[kind]
    word = "[A-Za-z0-9_À-ÿ]"
    group = lambda c: F.when(c == "", "end").when(c.rlike(r"\s"), "space").when(c.rlike(word), "word").otherwise("mark")
    return {
        "regex": vote(F.lower(right).rlike(NAMED), ~first.isin(GIVEN_NAMES)) if kind == "person" else vote(good | cards, F.lit(kind != "card") | (digits >= 14)),
        "gazetteer": gazetteer,
        "context": vote(F.lower(left).rlike(CONTEXT[kind]), F.lower(left).rlike(AGAINST)),
        "shape": shape,
        "border": vote(left.rlike(LABEL) & ~after.rlike(f"^{word}$"), before.rlike(f"^(?:{word}|[.+-])$") | after.rlike(f"^{word}$")),
        "before": group(before),
        "after": group(after),
        "size": F.least(F.floor(F.length(match) / 4), F.lit(8)).cast("string"),
    }


def matches(text: Column, kind: str, body) -> Column:
    """``body(matches, the text between them)``, or null if the text can't have a match."""
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(hint, let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda gaps: body(m, gaps)))))


def candidates(text: Column, places: bool) -> Column:
    """Array of all candidates: kind, base (does it pass the base check), votes, categories and, if asked, start and end."""

    def of_kind(kind: str) -> Column:
        def body(m: Column, gaps: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                good = valid(kind, x)
                known = signals(kind, x, F.right(F.get(gaps, i), F.lit(BEFORE)), F.left(F.get(gaps, i + 1), F.lit(AFTER)), good)
                return F.struct(F.lit(kind).alias("kind"), good.alias("base"), F.length(x).alias("length"), *(c.alias(n) for n, c in known.items()))

            found = F.transform(m, one)
            if not places:
                return found
            # A start is all text between matches up to here and all matches before.
            before = running_sum(F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x)))
            start = F.zip_with(before, F.slice(gaps, F.lit(1), F.size(m)), lambda b, gap: b + F.length(gap))
            return F.zip_with(found, start, lambda f, s: f.withField("start", s).withField("end", s + f["length"]))

        return matches(text, kind, body)

    kinds = [of_kind(kind) for kind in PATTERNS]
    return F.flatten(F.array_compact(F.array(*kinds)))


class SpanClassifier:
    """Naive Bayes weights by kind, category and value; ``added`` tells whether a candidate counts."""

    def __init__(self, prior: dict[str, float], weights: dict[str, float]):
        self.prior, self.weights = prior, weights

    def added(self, candidate: Column) -> Column:
        """False for base spans (they stay anyway) and for kinds that get no further spans."""
        if not self.prior:
            return F.lit(False)
        table = lambda entries: F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))
        score = F.try_element_at(table(self.prior), candidate["kind"])
        for f in FEATURES if self.weights else ():
            score = score + F.coalesce(F.try_element_at(table(self.weights), F.concat_ws("|", candidate["kind"], F.lit(f), candidate[f])), F.lit(0.0))
        return ~candidate["base"] & candidate["kind"].isin(*ADDED) & F.coalesce(score > 0, F.lit(False))


def expectation_maximisation(patterns: dict[tuple[str, ...], int], rounds: int = 50, first: float = 0.5) -> dict[tuple[str, ...], float]:
    """Probability of yes for each pattern of votes (one kind's), by EM for independent labelers.

    Labelers are taken to be right 8 times in 10 by 20 imagined votes each, which also keeps yes
    and no from changing places; the share of yes lies half way between ``first`` and what the votes say,
so that candidates on which no labeler says anything of use keep to ``first``.
    """
    rate = {(i, truth): 0.8 if truth else 0.2 for i in range(len(LABELERS)) for truth in (0, 1)}  # P(vote yes | truth, votes)
    share = first
    posterior: dict[tuple[str, ...], float] = {}
    for _ in range(rounds):
        for votes in patterns:
            odds = math.log(share / (1 - share))
            for i, v in enumerate(votes):
                if v != "-":
                    yes, no = rate[i, 1], rate[i, 0]
                    odds += math.log(yes / no) if v == "y" else math.log((1 - yes) / (1 - no))
            posterior[votes] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        total = sum(patterns.values())
        share = (first + sum(n * posterior[v] for v, n in patterns.items()) / total) / 2
        for i in range(len(LABELERS)):
            for truth in (0, 1):
                said, of = (16.0, 20.0) if truth else (4.0, 20.0)
                for votes, n in patterns.items():
                    if votes[i] != "-":
                        mass = n * (posterior[votes] if truth else 1 - posterior[votes])
                        of += mass
                        said += mass * (votes[i] == "y")
                rate[i, truth] = said / of
    return posterior


def train(found: DataFrame) -> SpanClassifier:
    """Classifier from ``found`` (rows with the array ``found`` of candidates). Two aggregates; bounded results come to the driver."""
    spark = found.sparkSession
    each = found.select(F.explode("found").alias("c")).select("c.*")
    counts = each.groupBy("kind", *LABELERS).count().collect()
    by_kind: dict[str, dict[tuple[str, ...], int]] = defaultdict(dict)
    for r in counts:
        by_kind[r.kind][tuple(r[f] for f in LABELERS)] = r["count"]
    if not by_kind:
        return SpanClassifier({}, {})
    learned = [(k, *v, p) for k, patterns in sorted(by_kind.items()) for v, p in expectation_maximisation(patterns, first=SHARE[k]).items()]
    votes = spark.createDataFrame(learned, "kind string, " + ", ".join(f"{f} string" for f in LABELERS) + ", p double")
    weighed = each.join(F.broadcast(votes), ["kind", *LABELERS])  # at most 5 * 3**5 rows
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES)))
    sums = weighed.select("kind", "p", values.alias("f")).groupBy("kind", "f.feature", "f.value").agg(F.sum("p").alias("yes"), F.count("*").alias("n")).collect()
    size: dict[tuple[str, str], int] = defaultdict(int)
    yes: dict[tuple[str, str], float] = defaultdict(float)
    rows: dict[tuple[str, str], float] = defaultdict(float)
    for r in sums:
        size[r.kind, r.feature] += 1
        yes[r.kind, r.feature] += r.yes
        rows[r.kind, r.feature] += r.n
    weights = {
        f"{r.kind}|{r.feature}|{r.value}": math.log((r.yes + 1) / (yes[r.kind, r.feature] + size[r.kind, r.feature]))
        - math.log((r.n - r.yes + 1) / (rows[r.kind, r.feature] - yes[r.kind, r.feature] + size[r.kind, r.feature]))
        for r in sums
    }
    f = FEATURES[0]
    prior = {k: math.log((yes[k, f] + 1) / (rows[k, f] - yes[k, f] + 1)) for k in by_kind}
    return SpanClassifier(prior, weights)


def _chosen(found: Column, classifier: SpanClassifier) -> Column:
    """The spans among candidates: array of (start, rank, end, kind, base), in order."""
    name = lambda c: F.when(c["base"], c["kind"]).when(c["kind"] == "card", F.lit("number")).otherwise(c["kind"])
    order = F.create_map(*(F.lit(x) for i, k in enumerate((*BASE, "number", "person")) for x in (k, i)))
    listed = F.transform(
        F.filter(found, lambda c: c["base"] | classifier.added(c)),
        lambda c: F.struct(c["start"].alias("start"), F.try_element_at(order, name(c)).alias("rank"), c["end"].alias("end"), name(c).alias("kind"), c["base"].alias("base")),
    )
    return F.sort_array(listed)


def spans(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` of every row and ``spans``: array of (start, rank, end, kind, base), in order.

    Candidates are found once and written; training and the final choice read that table.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = written(docs.select(*keep, candidates(text, places=True).alias("found")))
    return found.select(*keep, _chosen(F.col("found"), train(found)).alias("spans"))


def _without(text: Column, spans_: Column) -> Column:
    """``text`` rebuilt from the gaps between spans; spans that overlap or touch inside each other become one, named by the first."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("upto"))
    cut = lambda begin, length: F.substring(text, (begin + 1).cast("int"), length.cast("int"))

    def add(state: Column, span: Column) -> Column:
        gap = cut(state["upto"], span["start"] - state["upto"])
        new = F.concat(state["done"], gap, F.lit("<"), F.upper(span["kind"]), F.lit(">"))
        return F.struct(F.when(span["start"] < state["upto"], state["done"]).otherwise(new).alias("done"), F.greatest(state["upto"], span["end"].cast("long")).alias("upto"))

    return F.aggregate(spans_, start, add, lambda s: F.concat(s["done"], cut(s["upto"], F.length(text))))


def masked(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every span of ``spans`` replaced by its kind in angle brackets; null texts stay null.

    Spans are those of the original text. Of spans that overlap no character stays: together they
    become the kind of the one that begins first (of several, the first kind as ``BASE`` lists them).
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # Training reads a narrow table of candidates; texts are searched once more for their spans, not written beside them.
    classifier = train(written(docs.select(candidates(text, places=False).alias("found"))))
    chosen = let(candidates(text, places=True), lambda found: _chosen(found, classifier))
    result = let(chosen, lambda spans_: F.when(F.size(spans_) > 0, _without(text, spans_)).otherwise(text))
    return docs.withColumn(text_column, F.when(F.col(text_column).isNotNull(), result))
