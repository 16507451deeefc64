"""Consensus labels, annotator reliability and chance-corrected agreement from disagreeing annotators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import Workspace

#: Most numbers that the confusion matrices of all questions may hold; they are sent to every task.
PARAMETERS = 8_000_000
#: Pseudo-counts by which a question's confusion matrix is drawn to that of its field, and that to a fair annotator.
SMOOTH_FIELD = 6.0
SMOOTH = 1.0
#: Correlation of the errors of two annotators, given the truth, from which they count as one joint witness.
DEPENDENT = 0.25
#: Most annotators whose joint answers have a matrix of their own (its alphabet grows as the product of theirs); of more
#: dependent ones each keeps its matrix, and their votes weigh together as much as they are independent.
JOINT = 3
#: Votes by which a correlation is drawn toward none.
SHRINK = 25.0


#: Labels of a set that fit into the bits of one number.
BITS = 62


@dataclass
class Question:
    """One thing that annotators answer: a field with its possible values, or one label of a set field (values false, true)."""

    name: str
    field: str
    values: list[str]


@dataclass(frozen=True)
class Scale:
    """A field of the votes: one of `labels`, or, where `many`, any set of them."""

    field: str
    labels: tuple[str, ...]
    many: bool = False

    def questions(self) -> list[Question]:
        return [Question(f"{self.field}:{x}", self.field, ["false", "true"]) for x in self.labels] if self.many else [Question(self.field, self.field, list(self.labels))]


class Votes:
    """The votes of a block of answer patterns: for each vote its row, its annotator and its answer (1 + the place of the value)."""

    def __init__(self, patterns: pa.ListArray):
        self.size = len(patterns)
        lengths, flat = patterns.value_lengths().to_numpy(), patterns.flatten().to_numpy().astype(np.int64)
        self.row, self.annotator, self.code = np.repeat(np.arange(self.size), lengths), flat >> 8, flat & 255

    def total(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights, minlength=self.size)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Votes, np.ndarray]]:
    """(question, rows, votes, counts) for each run of one question in the batches, which are sorted by question."""
    for batch in batches:
        q = batch.column("q").to_numpy()
        bounds = np.flatnonzero(np.diff(q, prepend=q[:1] - 1)) if len(q) else []
        for start, end in zip(bounds, [*bounds[1:], len(q)]):
            part = batch.slice(start, end - start)
            yield int(q[start]), part, Votes(part.column("pattern")), part.column("n").to_numpy().astype(float)


def _table(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.RecordBatch.from_pydict({k: pa.array(np.asarray(columns[k]), kinds[t]) for k, t in (c.split() for c in schema.split(", "))})


class Model:
    """Confusion matrices: for each question and witness the chance of each answer given each true value.

    A witness is one annotator, or up to JOINT whose errors go together; the answers of a joint witness are
    the combinations of theirs (0 = no answer). The votes of more than JOINT dependent annotators are
    weighted down to the number of independent voices among them.
    """

    def __init__(self, questions: list[Question], annotators: int, groups: list[tuple[list[int], float]]):
        self.questions, self.annotators = questions, annotators
        self.joint = [w for w, _ in groups if 1 < len(w) <= JOINT]
        self.weight = np.ones(annotators)
        for w, r in groups:
            self.weight[w] = 0.0 if 1 < len(w) <= JOINT else 1 / (1 + (len(w) - 1) * max(r, 0.0))
        self.prior: list[np.ndarray] = []
        self.single: list[np.ndarray] = []
        self.log: list[list[np.ndarray]] = []
        need = sum(len(q.values) * ((len(q.values) + 1) * annotators + sum((len(q.values) + 1) ** len(w) for w in self.joint)) for q in questions)
        if need > PARAMETERS:
            raise ValueError(f"{need} confusion parameters are more than {PARAMETERS}")

    def symbol(self, votes: Votes, k: int, w: list[int]) -> np.ndarray:
        power = np.zeros(self.annotators)
        power[w] = [float((k + 1) ** i) for i in range(len(w))]
        return votes.total(votes.code * power[votes.annotator]).astype(np.int64)

    def posterior(self, q: int, votes: Votes) -> np.ndarray:
        """Chance of each value per answer pattern."""
        k = len(self.questions[q].values)
        score = np.tile(np.log(self.prior[q]), (votes.size, 1))
        weight = self.weight[votes.annotator]
        for v in range(k):
            score[:, v] += votes.total(weight * self.single[q][v, votes.annotator, votes.code])
        for w, table in zip(self.joint, self.log[q]):
            score += table[:, self.symbol(votes, k, w)].T
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(1, keepdims=True)

    def empty(self) -> list[list[np.ndarray]]:
        """Sums of no votes: for each question the matrices of the single annotators, then those of the joint witnesses."""
        return [[np.zeros((len(q.values), self.annotators, len(q.values) + 1)), *[np.zeros((len(q.values), (len(q.values) + 1) ** len(w))) for w in self.joint]] for q in self.questions]


def _fit(model: Model, sums: list[list[np.ndarray]], priors: list[np.ndarray]) -> None:
    """M step: matrices from expected counts, smoothed toward their field's and toward a fair annotator."""
    fields: dict[tuple[str, int, int], np.ndarray] = {}
    for q, question in enumerate(model.questions):
        # what an annotator didn't answer is what is left of all
        sums[q][0][:, :, 0] = priors[q][:, None] - sums[q][0][:, :, 1:].sum(2)
        for i, part in enumerate(sums[q]):
            key = (question.field, len(question.values), i)
            fields[key] = fields.get(key, 0) + part
    model.prior, model.single, model.log = [], [], []
    for q, question in enumerate(model.questions):
        k = len(question.values)
        model.prior.append((priors[q] + 1.0) / (priors[q] + 1.0).sum())
        for i, w in enumerate([[0], *model.joint]):
            size = (k + 1) ** len(w)
            symbols = np.arange(size)[:, None] // (k + 1) ** np.arange(len(w)) % (k + 1)  # the answers in each symbol
            fair = np.full((k, size), 0.3 / size)
            for v in range(k):
                fair[v, ((symbols == v + 1) | (symbols == 0)).all(1) & (symbols > 0).any(1)] += 0.7 / (2 ** len(w) - 1)
            fair /= fair.sum(1, keepdims=True)
            pooled = fields[(question.field, k, i)]
            fair = fair[:, None, :] if i == 0 else fair
            base = (pooled + SMOOTH * fair) / (pooled + SMOOTH * fair).sum(-1, keepdims=True)
            table = sums[q][i] + SMOOTH_FIELD * base
            # what a witness leaves unanswered tells nothing: condition on which of its members answered
            given = np.ones_like(table)
            masks = (symbols > 0) @ (1 << np.arange(len(w)))
            for mask in range(1, 1 << len(w)):
                part = table[..., masks == mask]
                given[..., masks == mask] = part / part.sum(-1, keepdims=True)
            log = np.log(np.maximum(given, 1e-12))
            if i == 0:
                model.single.append(log)
                model.log.append([])
            else:
                model.log[q].append(log)


def _step(patterns: DataFrame, model: Model, target: Model) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """E step over all patterns in one job: the posteriors of `model`, and the expected counts for the matrices of `target`.

    Each task returns the sums of its own patterns; they are added up before they come to the driver, which
    gets no more numbers than there are parameters.
    """

    schema = "q int, i int, v int, s bigint, x double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        priors: dict[int, np.ndarray] = {}
        for q, _, votes, n in _blocks(batches):
            k = len(model.questions[q].values)
            weighted = model.posterior(q, votes) * n[:, None]
            priors[q] = priors.get(q, 0) + weighted.sum(0)
            place = votes.annotator * (k + 1) + votes.code
            tables = [np.stack([np.bincount(place, weights=weighted[votes.row, v], minlength=target.annotators * (k + 1)) for v in range(k)])]
            for w in target.joint:
                s = target.symbol(votes, k, w)
                tables.append(np.stack([np.bincount(s, weights=weighted[:, v], minlength=(k + 1) ** len(w)) for v in range(k)]))
            sums[q] = [x + y for x, y in zip(sums[q], tables)] if q in sums else tables
        parts = [(q, -1, priors[q][None, :]) for q in priors] + [(q, i, t) for q, ts in sums.items() for i, t in enumerate(ts)]
        for q, i, t in parts:
            v, place = np.nonzero(t)
            yield _table(schema, q=np.full(len(v), q), i=np.full(len(v), i), v=v, s=place, x=t[v, place])

    added = patterns.mapInArrow(run, schema).groupBy("q", "i", "v", "s").agg(F.sum("x").alias("x")).toArrow()
    q_, i_, v_, s_, x_ = (added.column(c).to_numpy() for c in ("q", "i", "v", "s", "x"))
    sums, priors = target.empty(), [np.zeros(len(q.values)) for q in target.questions]
    for q in range(len(target.questions)):
        for i in range(-1, 1 + len(target.joint)):
            mine = (q_ == q) & (i_ == i)
            if i < 0:
                priors[q][s_[mine]] = x_[mine]
            else:
                table = sums[q][i].reshape(sums[q][i].shape[0], -1)
                table[v_[mine], s_[mine]] = x_[mine]
    return sums, priors


def _em(patterns: DataFrame, model: Model, rounds: int, close: float, first: Model | None = None) -> None:
    """Fits `model`, from the posteriors of `first`, else from a smoothed majority (every annotator fair)."""
    if first is None:
        _fit(model, model.empty(), [np.zeros(len(q.values)) for q in model.questions])
    before: list[np.ndarray] | None = None
    for _ in range(rounds):
        sums, priors = _step(patterns, first or model, model)
        first = None
        _fit(model, sums, priors)
        after = [np.exp(t) for x, ys in zip(model.single, model.log) for t in (x, *ys)]
        if before is not None and max(float(np.abs(a - b).max()) for a, b in zip(before, after)) < close:
            break
        before = after


def _dependent(patterns: DataFrame, model: Model) -> list[tuple[list[int], float]]:
    """(annotators, mean correlation): groups of annotators whose errors are correlated given the consensus, on average over all pairs of a group."""
    a = model.annotators
    if a < 2:
        return [([i], 0.0) for i in range(a)]

    schema = "i int, j int, xy double, xx double, yy double, m double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, a, a))
        for q, _, votes, n in _blocks(batches):
            p = model.posterior(q, votes)
            # chance to err here that the model expects of each annotator, over the possible truths
            good = np.exp(np.stack([model.single[q][v, :, v + 1] for v in range(p.shape[1])]))
            right = p[votes.row, np.maximum(votes.code - 1, 0)]
            expected = 1 - (p[votes.row] * good[:, votes.annotator].T).sum(1)
            residual, said = np.zeros((votes.size, a)), np.zeros((votes.size, a))
            residual[votes.row, votes.annotator] = (1 - right) - expected
            said[votes.row, votes.annotator] = 1.0
            weighted, squared = residual * n[:, None], residual**2 * n[:, None]
            total += np.stack([weighted.T @ residual, squared.T @ said, said.T @ squared, (said * n[:, None]).T @ said])
        i, j = np.nonzero(np.triu(total[3], 1))
        yield _table(schema, i=i, j=j, xy=total[0][i, j], xx=total[1][i, j], yy=total[2][i, j], m=total[3][i, j])

    rows = patterns.mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy", "m")]).toArrow().to_pandas()
    r = np.zeros((a, a))
    scale = np.sqrt(rows["xx"].to_numpy() * rows["yy"].to_numpy())
    m = rows["m"].to_numpy()
    r[rows["i"], rows["j"]] = np.where(scale > 0, rows["xy"].to_numpy() / np.maximum(scale, 1e-300), 0.0) * m / (m + SHRINK)
    r = r + r.T
    groups = [[i] for i in range(a)]
    between = r.copy()
    np.fill_diagonal(between, -1.0)
    while len(groups) > 1:  # the two groups most alike on average are joined
        i, j = np.unravel_index(between.argmax(), between.shape)
        if between[i, j] < DEPENDENT:
            break
        i, j = min(i, j), max(i, j)
        mean = (between[i] * len(groups[i]) + between[j] * len(groups[j])) / (len(groups[i]) + len(groups[j]))
        groups[i] += groups.pop(j)
        between[i, :] = between[:, i] = mean
        between = np.delete(np.delete(between, j, 0), j, 1)
        np.fill_diagonal(between, -1.0)
    return [(sorted(g), float(r[np.ix_(g, g)].sum() / (len(g) * (len(g) - 1))) if len(g) > 1 else 0.0) for g in groups]


def _code(scale: Scale) -> Column:
    """The column `value` as numbers: 1 + its place on the scale, or the bits of a set; null where it doesn't fit the scale."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(scale.labels) for x in (v, i)])
    places = F.transform("value", lambda x: F.try_element_at(table, x))
    fits = F.col("value").isNotNull() & ~F.exists(places, lambda x: x.isNull())
    if not scale.many:
        return F.when(fits & (F.size("value") == 1), F.array((places[0] + 1).cast("bigint")))

    def bits(i: int) -> Column:
        mine = F.filter(F.array_distinct(places), lambda x: x.between(i, i + BITS - 1))
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda s, x: s + F.pow(F.lit(2.0), x - i).cast("bigint"))

    return F.when(fits, F.array(*[bits(i) for i in range(0, len(scale.labels), BITS)]))


def consensus(votes: DataFrame, scales: list[Scale], least: int = 3, rounds: int = 60, close: float = 1e-4) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(labels, reliability, agreement, dependence) from votes (item, field, annotator, value array).

    `item` is any one column; value holds one label of the field's scale, or a set of labels. Items with
    fewer than `least` annotators are left out. Label posteriors and the confusion matrix of every
    annotator are estimated by expectation-maximisation with smoothing, each label of a set as a question
    of its own; annotators whose errors go together given the truth are estimated as one joint witness (more
    than JOINT of them by votes weighted down to their independent voices), so a copy of an annotator adds no weight. Items with the same answers are one pattern with a count, so
    an iteration costs the number of patterns; only expected counts, as many as there are parameters, come
    to the driver, and their number is checked. Agreement (Krippendorff's alpha, nominal) is computed from
    the votes alone, apart from the model.

    Defined cases: a null value, a label outside the scale, an unknown field and a null annotator make no
    vote; an empty set is a vote; of several votes of an annotator on one field of an item the one with
    the greatest code counts; ties of the posterior go to the label declared first; an empty input gives
    empty tables. Other columns are ignored.
    """
    spark = votes.sparkSession
    space = Workspace(spark, "consensus")
    if max((len(s.labels) for s in scales if not s.many), default=0) > 200:
        raise ValueError("a scale has more than 200 labels")
    if not scales:
        raise ValueError("no scales")
    parts: list[Scale] = []
    for scale in scales:
        step = BITS if scale.many else max(1, len(scale.labels))
        parts += [Scale(scale.field, scale.labels[i : i + step], scale.many) for i in range(0, len(scale.labels), step)]
    questions, first = [], []
    for part in parts:
        first.append(len(questions))
        questions += part.questions()
    # the value as a number: 1 + its place on the scale, or the bits of a set
    code = None
    for scale in scales:
        value = _code(scale)
        code = F.when(F.col("field") == scale.field, value) if code is None else code.when(F.col("field") == scale.field, value)
    coded = votes.filter(F.col("annotator").isNotNull()).select("item", "field", "annotator", F.explode(F.array(F.struct(code.alias("c")))).alias("x")).filter("x.c IS NOT NULL").select("item", "field", "annotator", F.col("x.c").alias("c"))
    coded = space.keep(coded)
    annotators = [r[0] for r in coded.select("annotator").distinct().orderBy("annotator").limit(10_001).collect()]
    if len(annotators) > 10_000:
        raise ValueError("more than 10,000 annotators")
    kind = coded.schema["annotator"].dataType.simpleString()
    width = len(annotators)
    if not width:
        item = coded.limit(0).select("item")
        return (
            item.select("item", F.lit("").alias("question"), F.lit("").alias("value"), F.lit(0.0).alias("posterior"), F.lit(0).alias("annotators")),
            spark.createDataFrame([], f"annotator {kind}, question string, votes double, accuracy double, informedness double"),
            spark.createDataFrame([], "field string, question string, alpha double, observed double, chance double, items double"),
            spark.createDataFrame([], "annotator string, witness string"),
        )
    index = spark.createDataFrame([(x, i) for i, x in enumerate(annotators)], f"annotator {kind}, a int")
    per_item = coded.join(F.broadcast(index), "annotator").groupBy("item", "field").agg(F.collect_list(F.struct("a", "c")).alias("v"))
    # of several votes of one annotator the greatest code counts: the last one of the sorted votes
    per_item = per_item.select("item", "field", F.explode(F.array(F.array_sort("v"))).alias("v"))
    last = F.filter("v", lambda x, i: (i + 1 == F.size("v")) | (F.get("v", i + 1)["a"] != x["a"]))
    per_item = per_item.select("item", "field", F.explode(F.array(last)).alias("m")).withColumn("k", F.size("m")).filter(F.col("k") >= least)
    # one row per question: its votes as annotator and answer in one number; the votes of an item are grouped once, its labels are made here
    ask = None
    for scale in scales:
        mine = [(i, p) for i, p in enumerate(parts) if p.field == scale.field]
        rows = F.array(*[F.struct(F.lit(first[i] + j).alias("q"), F.lit(n).alias("part"), F.lit(j if p.many else -1).alias("bit")) for n, (i, p) in enumerate(mine) for j in range(len(p.labels) if p.many else 1)])
        ask = F.when(F.col("field") == scale.field, rows) if ask is None else ask.when(F.col("field") == scale.field, rows)
    spread = per_item.select("item", "k", "m", F.inline(ask))
    said = lambda x: x["c"][F.col("part")]
    answer = lambda x: F.when(F.col("bit") < 0, said(x)).otherwise(F.expr("shiftleft(1L, greatest(bit, 0))").bitwiseAND(said(x)).cast("boolean").cast("int") + 1)
    items = space.keep(spread.select("item", "q", F.transform("m", lambda x: x["a"] * 256 + answer(x).cast("int")).alias("pattern"), F.col("k").alias("annotators")))
    space.drop(coded)
    patterns = space.keep(items.groupBy("q", "pattern").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("q"))
    alone = Model(questions, width, [([i], 0.0) for i in range(width)])
    _em(patterns, alone, rounds, close)
    groups = _dependent(patterns, alone)
    model = alone
    if len(groups) < width:
        model = Model(questions, width, groups)
        _em(patterns, model, rounds, close, first=alone)
    names = [q.name for q in questions]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, part, votes, _ in _blocks(batches):
            p = model.posterior(q, votes)
            values = pa.array([questions[q].values[b] for b in p.argmax(1)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("q"), part.column("pattern"), pa.array([names[q]] * len(p), pa.string()), values, pa.array(p.max(1))], ["q", "pattern", "question", "value", "posterior"])

    decided = space.keep(patterns.mapInArrow(decide, "q int, pattern array<int>, question string, value string, posterior double"))
    labels = items.join(decided, ["q", "pattern"]).select("item", "question", "value", "posterior", "annotators")

    def confusion(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], np.ndarray] = {}
        for q, _, votes, n in _blocks(batches):
            p = model.posterior(q, votes) * n[:, None]
            k = p.shape[1]
            place = votes.annotator * k + votes.code - 1
            table = np.stack([np.bincount(place, weights=p[votes.row, v], minlength=width * k) for v in range(k)]).reshape(k, width, k)
            for a in np.unique(votes.annotator).tolist():
                rows[(q, a)] = rows.get((q, a), 0) + table[:, a]
        cells = [(q, a, v, s, float(t[v, s])) for (q, a), t in rows.items() for v in range(len(t)) for s in range(len(t))]
        yield _table("q int, a int, v int, s int, n double", **{c: [x[i] for x in cells] for i, c in enumerate(("q", "a", "v", "s", "n"))})

    matrices = space.keep(patterns.mapInArrow(confusion, "q int, a int, v int, s int, n double").groupBy("q", "a", "v", "s").agg(F.sum("n").alias("n")))
    asked_ = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "q int, question string")
    rows = matrices.groupBy("q", "a", "v").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v") == F.col("s"), F.col("n")).otherwise(0.0)).alias("good"))
    rows = rows.join(F.broadcast(asked_), "q").join(F.broadcast(index), "a")
    reliability = rows.groupBy("annotator", "question").agg(F.sum("n").alias("votes"), (F.sum("good") / F.nullif(F.sum("n"), F.lit(0.0))).alias("accuracy"), (F.avg(F.col("good") / F.nullif(F.col("n"), F.lit(0.0)))).alias("informedness"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for q, _, votes, n in _blocks(batches):
            counts = np.stack([votes.total((votes.code == v + 1).astype(float)) for v in range(len(questions[q].values))], 1)
            m = counts.sum(1)
            ok = m > 1
            c, w, m = counts[ok], n[ok], m[ok]
            same = ((c * (c - 1)).sum(1) / (m - 1) * w).sum()
            out[q] = out.get(q, 0) + np.concatenate([[same, w.sum()], (c * w[:, None]).sum(0)])
        cells = [(q, i, float(x)) for q, a in out.items() for i, x in enumerate(a)]
        yield _table("q int, i int, x double", **{c: [x[i] for x in cells] for i, c in enumerate(("q", "i", "x"))})

    tallies: dict[int, dict[int, float]] = {}
    for q, i, x in patterns.mapInArrow(pairs, "q int, i int, x double").groupBy("q", "i").agg(F.sum("x")).collect():
        tallies.setdefault(q, {})[i] = x
    agreed = []
    for q, t in tallies.items():
        n = np.array([t.get(i + 2, 0.0) for i in range(len(questions[q].values))])
        total = n.sum()
        if total < 2:
            continue
        observed, chance = t[0] / total, float((n * (n - 1)).sum() / (total * (total - 1)))
        agreed.append((questions[q].field, names[q], float((observed - chance) / (1 - chance)) if chance < 1 else None, float(observed), float(chance), float(t.get(1, 0.0))))
    agreement = spark.createDataFrame(agreed, "field string, question string, alpha double, observed double, chance double, items double")
    dependence = spark.createDataFrame([(str(annotators[i]), str(annotators[w[0]])) for w, _ in groups for i in w], "annotator string, witness string")
    return labels, reliability, agreement, dependence
