"""Language identification in two steps: the family first, then linear support vector machines, one for each two
languages of the family.

Features are hashed byte n-grams of letters, lower-cased in ASCII. Each machine is fitted in a task of its own, all at
once, on a bounded sample of the labelled rows; every whole text is then scored in one pass.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import NOT_LETTER, kept

UNDETERMINED = "und"
#: Languages of a family; any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
}


@dataclass(frozen=True)
class Settings:
    """dims: places of hashed n-grams. per_language: about so many rows of each language are fitted on, drawn by a hash
    of the id; rows that share an id count once. rounds, penalty: of each support vector machine."""

    dims: int = 1024
    per_language: int = 1500
    rounds: int = 25
    penalty: float = 1e-4


@dataclass
class Model:
    """family_of: each language's family; machines: (a, b) -> weights and intercept; above 0 it is b."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[NOT_LETTER] = 32


def features(text: str, dims: int) -> np.ndarray:
    """Square roots of the counts of byte n-grams up to 3, hashed, at unit length."""
    counts = np.zeros(dims)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(raw), 1 << 20):
        b = _LOWER[raw[at : at + (1 << 20) + 2]]
        one, n = b + np.uint32(1), len(b)
        grams = [one]
        if n > 1:
            grams.append(one[:-1] * np.uint32(257) + one[1:])
        if n > 2:
            grams.append(grams[1][:-1] * np.uint32(257) + one[2:])
        for g in grams:
            counts += np.bincount((g * np.uint32(2654435761)) >> np.uint32(32 - int(dims - 1).bit_length()), minlength=dims)[:dims]
    counts = np.sqrt(counts)
    norm = np.sqrt((counts * counts).sum())
    return counts / norm if norm else counts


def fit(docs: DataFrame, use: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the text and language of the rows of docs where `use` holds and both are there. Numbers of rows of a
    language are counted over all rows; then about per_language of each are drawn. Rows with a null text or language
    teach nothing; where no row is left, the model knows no language. Columns of docs other than the three named are not
    looked at. The languages, a few hundred at most, come to the driver."""
    s = settings
    rows = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, s.per_language / n))])[F.col("lang")]
    # repeated ids are drawn together
    draw = (F.xxhash64("id", F.lit(11)).bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)) < share

    def measure(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            got = [features(t, s.dims).astype(np.float32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), batch.column(1)], ["x", "lang"])

    # an id that fills much of the table is one row of the sample
    once = rows.where(draw).groupBy("id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.text", "r.lang")
    sample = kept(once.mapInArrow(measure, "x binary, lang string"))
    family = {lang: name for name, langs in FAMILIES.items() for lang in langs}
    model = Model()
    for lang in sorted(counts):
        model.members.setdefault(family.get(lang, lang), []).append(lang)
    model.families = sorted(model.members)
    two = [(a, b, model.members[a], model.members[b]) for a, b in itertools.combinations(model.families, 2)]
    two += [(a, b, [a], [b]) for langs in model.members.values() for a, b in itertools.combinations(langs, 2)]
    if not two:
        return model
    sides = [(a, b, lang, side) for a, b, first, second in two for side, langs in ((-1, first), (1, second)) for lang in langs]
    dealt = sample.join(F.broadcast(docs.sparkSession.createDataFrame(sides, "a string, b string, lang string, side int")), "lang")

    def machine(table: pa.Table) -> pa.Table:
        x = np.empty((table.num_rows, s.dims), np.float32)
        for k, row in enumerate(table.column("x")):
            x[k] = np.frombuffer(row.as_buffer(), np.float32)
        w = support_vectors(x, table.column("side").to_numpy().astype(np.float64), s.penalty, s.rounds)
        return pa.table({"a": table.column("a")[:1], "b": table.column("b")[:1], "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    for r in dealt.groupBy("a", "b").applyInArrow(machine, "a string, b string, w array<double>").collect():
        model.machines[r["a"], r["b"]] = (np.array(r["w"][:-1]), r["w"][-1])
    return model


def support_vectors(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Weights and intercept (last) of a linear machine for sides y of -1 and 1: Newton's method on the mean squared hinge
    loss plus penalty times half the squared weights. Rows of the lesser side count for more, so that the sides weigh the
    same. Stops when the rows inside the margin stay the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    ridge = np.full(x.shape[1] + 1, penalty)
    ridge[-1] = 1e-9
    w, inside = np.zeros(len(ridge)), np.ones(len(x), bool)

    def blocks():  # in double precision a few rows at a time, as the whole would be twice what x is
        for at in range(0, len(x), 256):
            part = x[at : at + 256].astype(np.float64)
            yield slice(at, at + 256), np.hstack([part, np.ones((len(part), 1))])

    for _ in range(rounds):
        square, pull = np.diag(ridge), np.zeros(len(ridge))
        for at, part in blocks():
            part = part[inside[at]]
            weighed = part * (2 * weight[at][inside[at]])[:, None]
            square += weighed.T @ part
            pull += weighed.T @ y[at][inside[at]]
        w = np.linalg.solve(square, pull)
        now = np.concatenate([y[at] * (part @ w) < 1 for at, part in blocks()])
        if (now == inside).all() or not now.any():
            break
        inside = now
    return w


def _vote(x: np.ndarray, names: list[str], machines) -> tuple[np.ndarray, np.ndarray]:
    """For each row the name with most one-versus-one votes (ties: the larger sum of margins) and a confidence."""
    if len(names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    votes, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
        if (a, b) not in machines:  # a language whose rows the sample has missed
            continue
        w, c = machines[a, b]
        m = x @ w + c
        votes[np.arange(len(x)), np.where(m > 0, j, i)] += 1
        margins[:, j] += m
        margins[:, i] -= m
    best = np.argmax(votes + np.tanh(margins) / 4, axis=1)
    return best, 1 / (1 + np.exp(-3 * margins[np.arange(len(x)), best] / (len(names) - 1)))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model, settings: Settings = Settings(), text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score, or what `names` calls them (columns of docs of these names are replaced).

    The whole text is looked at, in pieces of bounded size. Null, empty and letterless texts are `und` with score 0, and so
    is everything when the model has learned nothing. A letter is what str.isalpha calls one. Repeated rows get the same
    answer; an empty table gives no rows. The other columns of docs pass through unseen.
    """
    s = settings
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in names]
    text_at = rest.index(text_col)

    def predict(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            told = [k for k, t in enumerate(texts) if t and m.families and has_letter(t)]
            for at in range(0, len(told), 256):
                some = np.array(told[at : at + 256])
                x = np.stack([features(texts[k], s.dims) for k in some])
                family, sure = _vote(x, m.families, m.machines)
                for f in np.unique(family):
                    own, langs = np.flatnonzero(family == f), m.members[m.families[f]]
                    best, inner = _vote(x[own], langs, m.machines)
                    for k, b in zip(some[own], best):
                        lang[k] = langs[b]
                    score[some[own]] = sure[own] * inner
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    return docs.select(*rest).mapInArrow(predict, f"{kinds}, `{names[0]}` string, `{names[1]}` double")
