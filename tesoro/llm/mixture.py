"""Mixing sources to target weights by hierarchical budgets.

Documents hang below a domain-language-source tree. A token budget flows down from the
root by the weights of siblings. A node that has fewer tokens than its share takes all
it has (times the allowed epochs); what it leaves goes to its siblings, and only what a
whole family can't use goes back to the family's siblings one level up. Every leaf then
takes whole seeded epochs and a token-prefix of the next one.

The prefix is found by refining token histograms over the bits of a seeded hash, so no
leaf is ever sorted or gathered, however many rows it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesoro.llm.common import prepare, read, steps, store, values

LEVELS = ("domain", "lang", "source")
SEED = 11
# Share of the available tokens that the mixture holds, and how often a document may repeat.
BUDGET_SHARE = 0.6
MAX_EPOCHS = 2
# Leaves of the tree that the driver may hold; more raise ValueError.
MAX_LEAVES = 200_000
# Bits of the seeded hash that one histogram resolves.
DIGIT_BITS = 10

# Target weights: of the domains, and of the languages in each; other names weigh
# DEFAULT_WEIGHT, and so do all sources of a language.
WEIGHTS = {("web",): 4.0, ("books",): 3.0, ("forum",): 2.0, ("code",): 1.0,
           **{(d, lang): w for d in ("web", "books", "forum", "code")
              for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}}
DEFAULT_WEIGHT = 1.0
DOMAINS = ("web", "books", "forum", "code")
NONE = "(none)"  # the name of a null in the tree


def domain_of_source() -> Column:
    """Sources are dealt to the domains by their trailing number; the first domain
    has those without one."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d{1,9})$", 1)
    place = F.coalesce(F.try_to_number(number, F.lit("999999999")).cast("long"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(place, F.lit(len(DOMAINS))) + 1).cast("int"))


def _share(budget: int, wants: list[tuple[Fraction, int]]) -> list[int]:
    """``budget`` tokens dealt to siblings of (weight, capacity): by weight, none above
    its capacity, what one can't take goes to the others; whole tokens, remainders to
    the largest fractions (first of equals). Weight 0 gets what no other can take."""
    given = [0] * len(wants)
    left = min(budget, sum(c for _, c in wants))
    open_ = [i for i, (w, c) in enumerate(wants) if w > 0 and c > 0]
    if not open_:
        open_ = [i for i, (_, c) in enumerate(wants) if c > 0]
        wants = [(Fraction(1), c) for _, c in wants]
    while left and open_:
        total = sum(wants[i][0] for i in open_)
        full = [i for i in open_ if left * wants[i][0] >= (wants[i][1]) * total]
        if full:  # these take all they have; deal the rest anew
            for i in full:
                given[i] = wants[i][1]
            left -= sum(wants[i][1] for i in full)
            open_ = [i for i in open_ if i not in set(full)]
            continue
        exact = {i: left * wants[i][0] / total for i in open_}
        for i in open_:
            given[i] = int(exact[i])
        rest = left - sum(given[i] for i in open_)
        for i in sorted(open_, key=lambda i: (given[i] - exact[i], i))[:rest]:
            given[i] += 1
        left = 0
    if left:  # only nodes of weight 0 are left
        again = [(Fraction(1) if given[i] == 0 else Fraction(0), c if given[i] == 0 else 0)
                 for i, (_, c) in enumerate(wants)]
        given = [g + x for g, x in zip(given, _share(left, again))]
    return given


def budgets(available: Mapping[tuple, int], budget: int, weights: Mapping[tuple, float],
            max_epochs: int = 1, default_weight: float = DEFAULT_WEIGHT) -> dict[tuple, int]:
    """Tokens of every leaf: ``available`` has the tokens of each leaf path, ``weights``
    the weight of a path among its siblings (``default_weight`` if it has none)."""
    def capacity(paths: list[tuple]) -> int:
        return sum(available[p] * max_epochs for p in paths)

    def deal(prefix: tuple, paths: list[tuple], tokens: int) -> dict[tuple, int]:
        if len(paths) == 1 and paths[0] == prefix:
            return {prefix: tokens}
        children: dict[tuple, list[tuple]] = {}
        for p in paths:
            children.setdefault(p[: len(prefix) + 1], []).append(p)
        names = sorted(children)
        parts = _share(tokens, [(Fraction(weights.get(c, default_weight)), capacity(children[c])) for c in names])
        out: dict[tuple, int] = {}
        for child, part in zip(names, parts):
            out |= deal(child, children[child], part)
        return out

    return deal((), sorted(available), min(budget, capacity(list(available)))) if available else {}


def word_count(narrow: DataFrame) -> DataFrame:
    """The columns of ``narrow`` with its last one, the text, counted in white-space words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            counts = [len((t or b"").split()) for t in values(step, "text")]
            yield pa.RecordBatch.from_arrays([*(step.column(i) for i in range(step.num_columns - 1)),
                                              pa.array(counts, pa.int64())], [*step.schema.names[:-1], "n_tokens"])
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{keys}, n_tokens long")


def _leaf(domain: Column) -> list[Column]:
    named = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return [F.coalesce(named[c].cast("string"), F.lit(NONE)).alias(f"_{c}") for c in LEVELS]


def _place(epoch: Column, seed: int) -> Column:
    """Place of a document in the order of an epoch: 64 seeded bits of its id and text."""
    return F.xxhash64(F.lit(seed), epoch, F.col("_id"), F.col("_text"))


def _digit(level: int) -> Column:
    """The ``level``-th group of DIGIT_BITS of the place, highest first, unsigned."""
    shift = max(0, 64 - DIGIT_BITS * (level + 1))
    bits = 64 - DIGIT_BITS * level - shift
    return F.shiftrightunsigned(F.col("place"), shift).bitwiseAND(F.lit((1 << min(bits, DIGIT_BITS)) - 1))


def plan(docs: DataFrame, weights: Mapping[tuple, float] = WEIGHTS, budget_share: float = BUDGET_SHARE,
         max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Callable[[], Column] = domain_of_source) -> DataFrame:
    """The small table of leaves: ``_domain, _lang, _source, whole`` (whole epochs taken)
    and ``cut``: documents whose place in the next epoch is up to it (as unsigned digits
    ``cut_0, cut_1, ...``) are taken once more; null: none are."""
    spark = docs.sparkSession
    path = [f"_{c}" for c in LEVELS]
    sized = store(word_count(docs.select(
        *_leaf(domain()), F.col("doc_id").cast("string").alias("_id"), F.xxhash64("text").alias("_text"),
        F.col("text").cast("binary").alias("text"))), "mixture-sizes")
    totals = sized.groupBy(*path).agg(F.sum("n_tokens").alias("tokens"))
    leaves = totals.limit(MAX_LEAVES + 1).collect()
    if len(leaves) > MAX_LEAVES:
        raise ValueError(f"the tree has over {MAX_LEAVES} leaves")
    available = {tuple(r[c] for c in path): int(r["tokens"]) for r in leaves}
    wanted = budgets(available, int(budget_share * sum(available.values())), weights, max_epochs)
    rows = []
    for leaf, tokens in wanted.items():
        whole = tokens // available[leaf] if available[leaf] else 0
        rows.append((*leaf, whole, tokens - whole * available[leaf]))
    kinds = "_domain string, _lang string, _source string, whole long, rest long"
    small = F.broadcast(spark.createDataFrame(rows, kinds))  # at most MAX_LEAVES rows
    cuts = _cuts(sized.join(small, path).where("rest > 0").withColumn("place", _place(F.col("whole"), seed)), path)
    return spark.createDataFrame(rows, kinds).join(
        F.broadcast(spark.createDataFrame(cuts, "_domain string, _lang string, _source string, cut array<long>")),
        path, "left")


def _cuts(open_rows: DataFrame, path: list[str]) -> list[tuple]:
    """``(*leaf, digits)``: the shortest prefix of the seeded order that holds the rest
    of the leaf's budget ends with the rows that have these digits. A level sums tokens
    by digit among the rows that share the digits so far, and goes on while any such
    last group has several places. Documents in one place (repeated rows) are taken together."""
    spark = open_rows.sparkSession
    found: list[tuple] = []
    rows, before = open_rows.withColumn("before", F.lit(0).cast("long")), 0
    for level in range(-(-64 // DIGIT_BITS)):
        sums = rows.groupBy(*path, _digit(level).alias("digit")).agg(
            F.sum("n_tokens").alias("tokens"), F.min("place").alias("a"), F.max("place").alias("b"),
            F.first("rest").alias("rest"), F.first("before").alias("before"))
        order = Window.partitionBy(*path).orderBy("digit")
        # at most 2 ** DIGIT_BITS rows a leaf, whatever the leaf holds
        reached = sums.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).where(
            F.col("upto") >= F.col("rest"))
        last = reached.groupBy(*path).agg(F.min(F.struct("digit", "upto", "tokens", "a", "b")).alias("last"))
        state = [(*(r[c] for c in path), r["last"]["digit"], r["last"]["upto"] - r["last"]["tokens"],
                  r["last"]["a"] == r["last"]["b"]) for r in last.collect()]
        known = {leaf[:3]: leaf[3] for leaf in found}
        found = [f for f in found if f[:3] not in {s[:3] for s in state}] + [
            (*s[:3], [*known.get(s[:3], []), s[3]]) for s in state]
        going = [(*s[:3], s[3], s[4]) for s in state if not s[5]]
        if not going:
            break
        next_ = F.broadcast(spark.createDataFrame(
            going, "_domain string, _lang string, _source string, _at long, _before long"))
        rows = (rows.join(next_, path).where(_digit(level) == F.col("_at"))
                    .withColumn("before", F.col("_before")).drop("_at", "_before"))
    return found


def _taken(cut: Column) -> Column:
    """The place's digits are up to the cut's, compared as far as the cut goes."""
    digits = F.array(*[_digit(level) for level in range(-(-64 // DIGIT_BITS))])
    return F.coalesce(F.slice(digits, 1, F.greatest(F.size(cut), F.lit(1))) <= cut, F.lit(False))


def epoch_column(docs: DataFrame) -> str:
    """Name of the column that ``mix`` adds: ``_epoch``, with more underscores in front as
    long as ``docs`` has a column of that name."""
    name, taken = "_epoch", {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def mix(docs: DataFrame, weights: Mapping[tuple, float] = WEIGHTS, budget_share: float = BUDGET_SHARE,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        domain: Callable[[], Column] = domain_of_source) -> DataFrame:
    """The chosen rows of ``docs``, all columns, with ``_epoch`` (0, 1, ...; named by
    ``epoch_column``) added: a document that the mixture repeats is there once for each
    epoch.

    A token is a white-space word. A leaf gets its budget, overshot by less than one
    document; documents without a word come with the prefix they stand in. Null
    domains, languages and sources form leaves named ``(none)``; null texts have no
    words; rows equal in id and text are taken together. Columns named like the tree's
    own (``_domain`` ...) or like those of ``plan`` are kept apart in a struct. An empty
    table gives an empty result.
    """
    path = [f"_{c}" for c in LEVELS]
    leaves = F.broadcast(plan(docs, weights, budget_share, max_epochs, seed, domain))
    held = docs.select(F.struct(*docs.columns).alias("_doc"), *_leaf(domain()),
                       F.col("doc_id").cast("string").alias("_id"), F.xxhash64("text").alias("_text"))
    times = (F.col("whole") + _taken(F.col("cut")).cast("long")).cast("int")
    return (held.join(leaves, path).withColumn("place", _place(F.col("whole"), seed))
                .withColumn("times", times).where("times > 0")
                .select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns],
                        F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias(epoch_column(docs))))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the target mixture, one row for each epoch that takes them."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    chosen = mix(docs)
    return chosen.select("doc_id", domain_of_source().alias("domain"), "lang", "source",
                         F.col(epoch_column(docs)).alias("epoch"))
