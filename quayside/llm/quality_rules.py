"""Quality by weak supervision: rules vote or abstain, expectation-maximisation says how far to trust each.

A rule looks at one trait of a text and votes *good* or *bad*, or abstains where the trait says
nothing. No rule is believed outright. The votes of all documents are counted by pattern (at most
three to the power of the number of rules, whatever the corpus size), and a latent class model with
rules independent within a class is fitted to those counts by expectation-maximisation: the share of
good documents and of each way to be bad, and how often each rule votes bad in each class. A rule whose bad
votes the other rules do not bear out founds no class: the fit then finds how often it errs among good documents. The
posterior probability of *good* then replaces an all-must-pass filter.

Everything is built-in column functions; only the pattern counts come to the driver.

Defined cases: a null text counts as empty; empty texts have no words and fail the base rules; repeated
rows are judged each on its own and count each in the fit; an empty table gives an empty
result (and a model that trusts the rules' prior weights); extra columns are carried by
:func:`keep_good` untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import BLANK_CLASS, stored, words_of

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Where the fit starts: the share of good documents, and bad votes of a rule among good documents, among those bad in
#: its own way and among those bad in another; and the weight of that start against the documents' votes.
GOOD, BAD_IF_GOOD, BAD_IF_OWN, BAD_IF_OTHER, PRIOR = 0.85, 0.002, 0.9, 0.05, 0.01
#: A rule founds a class if the share of its bad votes that another rule bears out, by a bad vote or an abstention, is greater by
#: this than the same share of its good votes; and so many imagined bad votes of each rule are borne out.
AGREEMENT, IMAGINED = 1 / 3, 5
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Votes bad or good where the SQL condition over the facts holds, else abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("duplicate lines", "n_lines > 1 AND n_dup_lines > 0.4 * n_lines", "n_lines > 1 AND n_dup_lines <= 0.2 * n_lines"),
    Rule("repetition", "n_repeat_words > 0.4 * n_words", "n_repeat_words <= 0.2 * n_words"),
    Rule("word length", "word_chars < 3 * n_words OR word_chars > 9 * n_words", "word_chars BETWEEN 4 * n_words AND 7 * n_words"),
    Rule("capitals", "n_capitals > 0.3 * word_chars", "n_capitals <= 0.1 * word_chars"),
    Rule("exclamations", "n_exclamations > 0.3 * n_words", "n_exclamations <= 0.05 * n_words"),
    Rule("line ends", "n_lines > 1 AND n_ended_lines < 0.3 * n_lines", "n_lines > 1 AND n_ended_lines > 0.7 * n_lines"),
)


def _count(text: Column, characters: str) -> Column:
    """How often any of the characters stands in the text; a plain search per character."""
    found = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in characters]
    return sum(found[1:], found[0])


def with_facts(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with a struct column ``out``: the facts of each text that rules can speak about.

    Repeated words are found per text by sorting its three-word windows by hash; texts without
    a repeated window (most) stop before the sort.
    """
    t, n = F.col("_t"), F.size("_words")
    work = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    work = work.withColumn("_words", words_of(t))
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    )
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{BLANK_CLASS[1:]}"))
    work = work.select(
        "_row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).cast("long").alias("n_symbols"),
        _count(t, "!").cast("long").alias("n_exclamations"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(
        repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    work = work.withColumns(
        {
            "_placed": placed,
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_ended_lines": F.size(F.filter("_lines", lambda x: x.rlike(rf"[.!?…:;\"'”»)]{BLANK_CLASS}*$"))).cast("long"),
        }
    )

    def same(x: Column, i: Column) -> Column:
        before, after = F.get("_placed", i - 1).getField("h"), F.get("_placed", i + 1).getField("h")
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_placed", same), lambda x: x["i"]))
    work = work.withColumn("_starts", F.when(F.col("_placed").isNotNull(), starts))
    covered = F.aggregate(
        F.transform("_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    facts = [*FACTS, "n_lines", "n_ended_lines", "n_capitals", "n_exclamations"]
    work = work.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # explode of one element: else a filter on the facts is pushed below all this and repeats it per mention
    return work.select("_row", F.explode(F.array(F.struct(*facts))).alias(out)).select("_row.*", out)


def base_failed(facts: str) -> Column:
    return (F.col(f"{facts}.n_words") < 50) | (100 * F.col(f"{facts}.n_repeat_words") > 50 * F.col(f"{facts}.n_words"))


def _votes(facts: str, rules: tuple[Rule, ...]) -> list[Column]:
    """Per rule 1 for good, 0 for bad, null for an abstention."""

    def over(condition: str) -> Column:
        names = [*FACTS, "n_lines", "n_ended_lines", "n_capitals", "n_exclamations"]
        for name in names:
            condition = condition.replace(name, f"{facts}.{name}")
        return F.expr(condition)

    return [F.when(over(r.bad), 0).when(over(r.good), 1) for r in rules]


@dataclass(frozen=True)
class LabelModel:
    """Class 0 holds the good documents, each further one those bad in the way of one rule that others bear out, in the order of
    the rules. Per class its share of the documents, and per rule the share of bad votes where the rule votes."""

    rules: tuple[Rule, ...]
    shares: tuple[float, ...]
    bad_votes: tuple[tuple[float, ...], ...]

    def posterior(self, votes: tuple[int | None, ...]) -> list[float]:
        """Probability of each class, given one document's votes."""
        logs = [
            math.log(share) + sum(0.0 if v is None else math.log(1 - p if v else p) for v, p in zip(votes, bad))
            for share, bad in zip(self.shares, self.bad_votes)
        ]
        most = max(logs)
        weights = [math.exp(x - most) for x in logs]
        return [w / sum(weights) for w in weights]

    def probability(self, facts: str) -> Column:
        """The posterior of the good class as a column."""
        votes = _votes(facts, self.rules)

        def log_likelihood(c: int) -> Column:
            total = F.lit(math.log(self.shares[c]))
            for vote, p in zip(votes, self.bad_votes[c]):
                total = total + F.when(vote == 1, math.log(1 - p)).when(vote == 0, math.log(p)).otherwise(0.0)
            return total

        good = log_likelihood(0)
        against = [F.exp(log_likelihood(c) - good) for c in range(1, len(self.shares))]
        return 1 / (1 + sum(against, F.lit(0.0)))


def borne_out(patterns: list[tuple[tuple[int | None, ...], int]], n_rules: int) -> list[int]:
    """The rules whose bad votes other rules bear out. One that others contradict wherever it fires tells of nothing but itself."""
    found = []
    for k in range(n_rules):
        share = []
        for vote, imagined in ((0, IMAGINED), (1, 0)):
            cast = [(any(v != 1 for v in votes[:k] + votes[k + 1 :]), n) for votes, n in patterns if votes[k] == vote]
            share.append((sum(n for agrees, n in cast if agrees) + imagined) / (sum(n for _, n in cast) + IMAGINED))
        if share[0] - share[1] >= AGREEMENT:
            found.append(k)
    return found


def em(patterns: list[tuple[tuple[int | None, ...], int]], rules: tuple[Rule, ...] = RULES, rounds: int = 50) -> LabelModel:
    """Fit by expectation-maximisation to (votes, documents) counts.

    Texts are bad in different ways, and each way is seen by few of the rules; with a single bad class the
    good votes of all the others would outweigh those few. So every rule that others bear out founds a class of its own,
    and the rounds find out how often the other rules join in, and how much of each class there is. A class of a rule
    that nobody bears out would explain each of its errors, however many; such a rule has none. A share of
    imagined documents that vote as at the start keeps every estimate off 0 and 1.
    """
    n_rules = len(rules)
    own = borne_out(patterns, n_rules)
    start = [[BAD_IF_GOOD] * n_rules]
    start += [[BAD_IF_OWN if j == k else BAD_IF_OTHER for j in range(n_rules)] for k in own]
    shares = [GOOD, *[(1 - GOOD) / len(own)] * len(own)] if own else [1.0]
    model = LabelModel(rules, tuple(shares), tuple(map(tuple, start)))
    weight = 1 + PRIOR * sum(n for _, n in patterns)
    for _ in range(rounds):
        rows = [(votes, n, model.posterior(votes)) for votes, n in patterns]
        found, bad_votes = [], []
        for c in range(len(shares)):
            found.append(sum(n * p[c] for _, n, p in rows) + weight * shares[c])
            of, no = [weight * shares[c]] * n_rules, [weight * shares[c] * x for x in start[c]]
            for votes, n, p in rows:
                for j, v in enumerate(votes):
                    of[j] += n * p[c] * (v is not None)
                    no[j] += n * p[c] * (v == 0)
            bad_votes.append(tuple(x / y for x, y in zip(no, of)))
        model = LabelModel(rules, tuple(x / sum(found) for x in found), tuple(bad_votes))
    return model


def fit(with_facts_df: DataFrame, facts: str, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """The label model of all rows: their votes counted by pattern, then :func:`em`."""
    names = [f"v{j}" for j in range(len(rules))]
    votes = with_facts_df.select(*[v.alias(n) for v, n in zip(_votes(facts, rules), names)])
    rows = votes.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(rules) rows
    patterns = sorted(((tuple(r[n] for n in names), r["n"]) for r in rows), key=repr)
    return em(patterns, rules)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, facts, base_failed, p_good, kept) per row of ``docs``.

    The facts are stored once in the shared folder, so that texts are read once for the fit and the verdicts."""
    narrow = with_facts(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", "facts")
    facts = stored(narrow.select("doc_id", "facts"))
    p = fit(facts, "facts").probability("facts")
    failed = base_failed("facts")
    return facts.select(
        "doc_id", "facts.*", failed.alias("base_failed"), p.alias("p_good"), (~failed & (p >= threshold)).alias("kept")
    )


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns as they are.

    Rows are stored once with their facts: the fit reads the facts alone, the filter the rows; no text is shuffled."""
    row, out = "row", "facts"
    wrapped = docs.select(F.struct("*").alias(row), F.col(f"`{text}`").alias("text"))
    facts = stored(with_facts(wrapped, "text", out).select(row, out))
    p = fit(facts.select(out), out).probability(out)
    return facts.where(~base_failed(out) & (p >= threshold)).select(f"{row}.*")
