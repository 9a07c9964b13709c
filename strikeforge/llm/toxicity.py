"""Toxic texts, learned from weak voters: label model first, linear classifier after."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeforge.llm.shared import column, fresh, id_key, pieces
from strikeforge.sources.tables import Stage

#: Abusive words by theme, one voter each; whole words, lower case.
LEXICON = {
    "insult": "idiot idiots moron morons loser losers clown clowns imbecile fool jerk",
    "contempt": "scum trash garbage filth vermin pathetic worthless useless",
    "disgust": "disgusting stupid dumb ugly hate vile repulsive",
    "german": "idiot dummkopf arschloch abschaum versager trottel depp schwein",
    "french": "idiot imbécile connard connasse salaud ordure minable débile",
    "spanish": "idiota imbécil estúpido estúpida basura escoria inútil asqueroso",
}
#: Phrases in the lower-cased text, one voter each, with words of which every hit holds one.
PHRASES = {
    "threat": (("kill", "hurt", "destroy"), r"\b(?:kill|hurt|destroy) (?:you|yourself|them)\b"),
    "command": (("shut", "lost", "away", "dead"), r"\b(?:shut up|get lost|go away|drop dead)\b"),
    "you_are": (("you",), r"\byou(?:['’]re| are)? (?:an? )?(?:\w+ )?(?:idiot|moron|loser|clown|disgrace)"
                r"|\byou people\b"),
}
_PHRASES = tuple((words, re.compile(pattern)) for words, pattern in PHRASES.values())
#: Marks of tone, one voter each: repeated exclamation, letters masked, capitals.
EXCLAIMING, MARKS, MASKED = "!!!", "*#$@", re.compile(r"\b\w{1,2}[*#$@]{2,}\w{0,3}\b")
SHOUTING = re.compile(r"(?:\b[A-ZÀ-Þ]{4,}\b[^a-zà-ÿ]{0,3}){4,}")
#: What every hit of the two holds; far faster to look for.
TWO_MARKS, FOUR_CAPITALS = re.compile("[*#$@]{2}"), re.compile("[A-ZÀ-Þ]{4}")
SHOUTED_SHARE, SHOUTED_LETTERS, SHOUTING_LETTERS = 0.6, 20, 16
#: Word parts that the label column speaks for; they fill this many voters by strength.
MINED_VOTERS = 6
#: Least documents with a part, and least lift of the toxic share, for a part to be mined.
MINED_DOCS, MINED_LIFT = 8, 4.0
#: Labelled rows that the classifier is fitted on, at most, by the hash of their id.
FIT_ROWS = 8_000
FEATURE_BITS = 18
#: Words whose weight a task remembers.
REMEMBERED = 200_000
THRESHOLD = 0.7
#: Weight of a given label in the posterior that the classifier learns.
TRUST = 0.9

_WORD = re.compile(r"\w+")


def crc(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text (none for NULL) leaves one, divided by three."""
    return crc(doc_id) % 3 == 1


_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def parts_of(word: str) -> list[str]:
    """The word, and its beginnings, which stand for its inflections."""
    return [word, *(word[:n] + "-" for n in (4, 5) if len(word) > n)]


def shouted(text: str) -> bool:
    """Four long words in capitals in a row, or mostly capitals among the letters of the Latin alphabet."""
    data = text.encode()
    high = len(data) - len(data.translate(None, _CAPITALS))
    # Capitals with accents begin with the byte C3.
    if high + data.count(b"\xc3") < SHOUTING_LETTERS:
        return False
    if FOUR_CAPITALS.search(text) and SHOUTING.search(text):
        return True
    low = len(data) - len(data.translate(None, _SMALL))
    return high >= SHOUTED_LETTERS and high >= SHOUTED_SHARE * (high + low)


# -- voters


@dataclass(frozen=True)
class Voters:
    """Each says whether a text holds what it looks for; mined parts are split by strength.

    ``parts`` has the voters of a word part as bits.
    """

    parts: dict[str, int]
    count: int

    @classmethod
    def of(cls, mined: Sequence[str]) -> Voters:
        parts: dict[str, int] = {}
        lists = [words.split() for words in LEXICON.values()]
        lists += [list(p) for p in np.array_split(np.array(mined, object), MINED_VOTERS)]
        for number, own in enumerate(lists):
            for part in own:
                parts[part] = parts.get(part, 0) | 1 << number
        return cls(parts, len(lists) + len(PHRASES) + 3)

    def votes(self, text: str | None, words: Counter) -> int:
        """The votes as bits: lexicons, mined parts, phrases, tone."""
        get, said = self.parts.get, 0
        for word in words:
            said |= get(word, 0) | get(word[:4] + "-", 0) | get(word[:5] + "-", 0)
        if text:
            low = text.lower()
            tone = [any(w in words for w in own) and bool(p.search(low)) for own, p in _PHRASES]
            tone.append(EXCLAIMING in text)
            tone.append(bool(
                any(m in text for m in MARKS) and TWO_MARKS.search(text) and MASKED.search(text)
            ))
            tone.append(shouted(text))
            for number, voted in enumerate(tone, self.count - len(tone)):
                said |= voted << number
        return said


def mined_parts(labelled: DataFrame) -> list[str]:
    """Parts that toxic rows of ``labelled(text, toxic)`` hold far more often than others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            docs, toxic = Counter(), Counter()
            for text, label in zip(column(batch, "text"), column(batch, "toxic")):
                own = {part for word in words_of(text) for part in parts_of(word)}
                docs.update(own)
                if label:
                    toxic.update(own)
            # Parts that no toxic text here holds matter only by their count elsewhere.
            names = list(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([docs[p] for p in names], pa.int64()),
                 pa.array([toxic[p] for p in names], pa.int64())], ["part", "n", "n_toxic"],
            )

    rows, bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == rows:
        return []
    counts = labelled.select("text", "toxic").mapInArrow(run, "part string, n long, n_toxic long")
    counts = counts.groupBy("part").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    share = F.col("n_toxic") / F.col("n")
    kept = counts.filter((F.col("n_toxic") >= MINED_DOCS) & (share >= min(0.5, MINED_LIFT * bad / rows)))
    # Strength: the share among holders, held back for rare parts, then how many it reaches.
    strength = (F.col("n_toxic") - 0.5) / (F.col("n") + 1)
    order = [F.desc(F.floor(strength * 50)), F.desc("n_toxic"), "part"]
    return [r["part"] for r in kept.orderBy(*order).collect()]


# -- label model


@dataclass
class LabelModel:
    """How likely each pattern of votes is under either label."""

    prior: float
    rates: np.ndarray  # voter, label: share of texts it votes for
    power: np.ndarray  # voter: how much of its word counts beside correlated voters

    def odds(self) -> tuple[np.ndarray, float]:
        """What each vote adds to the log odds, and the log odds without any vote."""
        without = np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0])) * self.power
        with_vote = np.log(self.rates[:, 1] / self.rates[:, 0]) * self.power
        return with_vote - without, float(np.log(self.prior / (1 - self.prior)) + without.sum())

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance that the label is 1, by rows of votes."""
        by_vote, none = self.odds()
        return 1 / (1 + np.exp(-np.clip(np.asarray(votes) @ by_vote + none, -30, 30)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation maximisation over distinct patterns of votes.

    ``counts`` has, per pattern, rows known as 0, known as 1, and unknown. Accuracies start from
    the known rows and are refined with all. Voters that agree beyond what the labels explain
    share their weight: each counts by one over the sum of its correlations inside the labels.
    """
    votes = votes.astype(float)
    known = counts[:, :2].sum(0)
    prior = float(np.clip((known[1] + 1) / (known.sum() + 2), 0.001, 0.999))
    model = LabelModel(prior, np.zeros((votes.shape[1], 2)), np.ones(votes.shape[1]))
    weight = np.stack([counts[:, 0], counts[:, 1]], 1).astype(float)
    if not known.all():  # no labels of one kind: a text with two votes or more starts as toxic
        likely = (votes.sum(1) >= 2).astype(float)
        weight = weight + np.stack([1 - likely, likely], 1) * counts[:, 2:3]
    for _ in range(rounds):
        mass = weight.sum(0)
        model.rates = np.clip((votes.T @ weight + [0.05, 0.5]) / (mass + 1), 1e-4, 1 - 1e-4)
        model.prior = float(np.clip((mass[1] + 0.5) / (mass.sum() + 1), 0.001, 0.999))
        model.power = 1 / _shared(votes, weight, model.rates)
        chance = model.posterior(votes)
        unknown = counts[:, 2]
        weight = np.stack(
            [counts[:, 0] + unknown * (1 - chance), counts[:, 1] + unknown * chance], 1
        )
    return model


def _shared(votes: np.ndarray, weight: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """One plus each voter's correlations with the others, those that both labels leave over."""
    total = np.zeros((votes.shape[1],) * 2)
    for label in (0, 1):
        off = votes - rates[:, label]
        cover = (off * weight[:, label : label + 1]).T @ off
        spread = np.sqrt(np.maximum(np.diag(cover), 1e-9))
        total += cover / np.outer(spread, spread) * weight[:, label].sum()
    alike = np.clip(total / max(weight.sum(), 1e-9), 0, 1)
    np.fill_diagonal(alike, 1)
    alike[alike < 0.1] = 0
    return alike.sum(1)


# -- classifier


def slots_of(word: str) -> tuple[int, int]:
    """Hashed features of a word: itself and its beginning."""
    space = 1 << FEATURE_BITS
    return zlib.crc32(word.encode()) % space, zlib.crc32((word[:4] + "-").encode()) % space


def scale_of(words: Counter) -> float:
    """Damps long texts: a word counts three times at most, by the root of the text's length."""
    return 1 / np.sqrt(1 + words.total())


def features(text: str | None, voters: Voters) -> tuple[list[int], list[float], int]:
    """Hashed features of a text, their values, and its votes; every vote is a feature too."""
    words, space = words_of(text), 1 << FEATURE_BITS
    at, values, scale = [], [], scale_of(words)
    for word, n in words.items():
        at += slots_of(word)
        values += [min(n, 3) * scale] * 2
    votes = voters.votes(text, words)
    said = [k for k in range(voters.count) if votes >> k & 1]
    return at + [space + k for k in said], values + [1.0] * len(said), votes


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float


def fit_classifier(
    at: np.ndarray, values: np.ndarray, sizes: np.ndarray, chances: np.ndarray, start: Classifier,
    rounds: int = 250, ridge: float = 1e-5, rate: float = 0.3,
) -> Classifier:
    """Logistic regression on posterior labels, by full gradients with per-weight steps.

    ``at`` and ``values`` hold the features of all rows one after another, ``sizes`` their number
    per row. Starts from the label model's own odds (``start``). The odds are then scaled and moved to fit the targets best.
    """
    owner = np.repeat(np.arange(len(sizes), dtype="i4"), sizes)
    used, place = np.unique(at, return_inverse=True)
    place = place.astype("i4")
    weights, squares = start.weights[used], np.full(len(used), 1e-8)
    bias, bias_square = start.bias, 1e-8
    for _ in range(rounds):
        odds = np.bincount(owner, values * weights[place], len(sizes)) + bias
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - chances
        slope = np.bincount(place, values * error[owner], len(used)) / len(sizes) + ridge * weights
        squares += slope**2
        weights -= rate * slope / np.sqrt(squares)
        bias_square += error.mean() ** 2
        bias -= rate * error.mean() / np.sqrt(bias_square)
    odds = np.bincount(owner, values * weights[place], len(sizes)) + bias
    slope, offset = _calibrated(odds, chances)
    whole = start.weights * slope
    whole[used] = weights * slope
    return Classifier(whole, bias * slope + offset)


def _calibrated(odds: np.ndarray, chances: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Slope and offset of the odds by Newton's method, held back slightly towards 1 and 0."""
    inputs, fit, start = np.stack([odds, np.ones(len(odds))], 1), np.array([1.0, 0.0]), [1.0, 0.0]
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(inputs @ fit, -30, 30)))
        slope = inputs.T @ (chance - chances) + 0.1 * (fit - start)
        bend = (inputs * (chance * (1 - chance))[:, None]).T @ inputs + 0.1 * np.eye(2)
        fit = fit - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return float(max(fit[0], 0.1)), float(fit[1])


# -- on Spark


def _over_texts(begin: Callable, names: Sequence[str], make: Sequence[pa.DataType]):
    """Runs what ``begin()`` gives over the texts of a task and passes other columns on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = begin()
        for batch in pieces(batches):
            rows = [one(text) for text in column(batch, "text")]
            made = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * len(make), make)]
            kept = [n for n in batch.schema.names if n != "text"]
            own = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*own, *made], [*kept, *names])

    return run


@dataclass
class Detector:
    voters: Voters
    model: LabelModel
    classifier: Classifier

    def scorer(self) -> Callable[[str | None], float]:
        """Scores texts; remembers the weights of words it has met, a bounded number."""
        weights, space, known = self.classifier.weights, 1 << FEATURE_BITS, {}
        by_vote = weights[space:]

        def score(text: str | None) -> float:
            words, total = words_of(text), 0.0
            for word, n in words.items():
                weight = known.get(word)
                if weight is None:
                    a, b = slots_of(word)
                    weight = float(weights[a] + weights[b])
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = weight
                total += min(n, 3) * weight
            votes = self.voters.votes(text, words)
            said = sum(float(w) for k, w in enumerate(by_vote) if votes >> k & 1)
            odds = total * scale_of(words) + said + self.classifier.bias
            return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

        return score


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          toxic: str = "toxic", fit_rows: int = FIT_ROWS) -> Detector:
    """Voters, label model and classifier from all texts and the labels that may be used.

    Labels count only where ``held_out`` is false, once per id (the largest, if they differ). Voters
    are fixed lexicons and patterns, and lexicons of all word parts that the labels single out. Every text votes; what reaches the driver is the count of each pattern of
    votes, of which there are at most 2 to the number of voters. The linear classifier is
    fitted on ``fit_rows`` labelled rows at most, by the hash of their id; its targets are the
    label model's posteriors, given votes and label.
    """
    stage, n_slots = Stage(docs.sparkSession), 1 << FEATURE_BITS
    given = labels.filter(F.col(toxic).isNotNull() & ~held_out()).select(
        id_key("doc_id").alias("key"), (F.col(toxic) > 0).cast("int").alias("toxic")
    ).groupBy("key").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(id_key(doc_id).alias("key"), F.col(text).alias("text"))
    may_teach = docs.filter(~held_out(doc_id)).select(
        id_key(doc_id).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")
    )
    # Copies teach once, else every word of a copied toxic text would look toxic. Texts are
    # shuffled once, whatever the number of labels, and only for the join that keeps them.
    once = may_teach.select("key", "mark").join(given, "key").groupBy("mark").agg(
        F.min("key").alias("key"), F.max("toxic").alias("toxic")
    )
    taught = may_teach.join(once.hint("merge"), ["key", "mark"])
    stage.write("labelled", taught.select("key", "toxic", "text"))
    labelled = stage.read("labelled")
    voters = Voters.of(mined_parts(labelled))

    votes = rows.mapInArrow(
        _over_texts(lambda: lambda t: (voters.votes(t, words_of(t)),), ["votes"], [pa.int64()]),
        "key long, votes long",
    )
    counted = votes.join(given, "key", "left").groupBy("votes").agg(
        F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1),
        F.count_if(F.col("toxic").isNull()),
    ).orderBy("votes").collect()
    bits = np.arange(voters.count)
    patterns = (np.array([r[0] for r in counted], "i8")[:, None] >> bits) & 1
    model = fit_label_model(patterns, np.array([list(r[1:]) for r in counted], float).reshape(-1, 3))

    order = F.xxhash64(F.lit("fit"), F.col("key"))
    chosen = labelled.select("key").distinct().orderBy(order, "key").limit(fit_rows)
    kinds = [pa.list_(pa.int32()), pa.list_(pa.float32()), pa.int64()]
    sample = labelled.join(chosen, "key", "left_semi").mapInArrow(
        _over_texts(lambda: lambda t: features(t, voters), ["at", "value", "votes"], kinds),
        "key long, toxic int, at array<int>, value array<float>, votes long",
    ).toArrow().combine_chunks().sort_by("key")
    by_vote, bias = model.odds()
    start = Classifier(np.concatenate((np.zeros(n_slots), by_vote)), bias)
    if not sample.num_rows:
        return Detector(voters, model, start)
    flat = [pa.chunked_array(sample[c]).combine_chunks() for c in ("at", "value")]
    at, value = (x.flatten().to_numpy() for x in flat)
    sizes = np.diff(flat[0].offsets.to_numpy())
    chance = model.posterior((sample["votes"].to_numpy()[:, None] >> bits) & 1)
    # A label that was given is one more voter, right nearly always.
    chance = (1 - TRUST) * chance + TRUST * sample["toxic"].to_numpy()
    return Detector(voters, model, fit_classifier(at, value, sizes, chance, start))


def score_toxicity(docs: DataFrame, detector: Detector, *, text: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """Every input row with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Only the text decides. NULL and empty texts have no words and get the score of a text without
    any feature. Input columns named like the two made are replaced; repeated rows are
    all returned, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    own = F.struct(*(docs[c] for c in names), F.lit(0).alias(fresh("_", docs)))
    packed = docs.select(own.alias("own"), docs[text].alias("text"))
    kind = packed.schema["own"].dataType.simpleString()

    def scorer() -> Callable[[str | None], tuple]:
        score = shared.value.scorer()
        return lambda t: (score(t),)

    scored = packed.mapInArrow(
        _over_texts(scorer, ["score"], [pa.float64()]),
        f"own {kind}, score double",
    )
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select(*(F.col(f"own.`{c}`") for c in names), "score", predicted)


def digest_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below the threshold."""
    scored = score_toxicity(docs, train(docs, labels))
    return scored.filter("predicted = 0").select(*docs.columns)
