"""Toxicity by a weighted finite-state pattern grammar (operator 2).

A text is read clause by clause through a chain of weighted transducers:

* the lexical one reads a word and writes a symbol: INSULT or THREAT with a
  weight, TARGET, NEGATION, REPORT, or WORD.  Its arcs are short general word
  lists and what labelled documents teach: whole words, and word beginnings
  that go on in many ways;
* ``negation`` marks insults and threats that a negation reaches;
* ``report`` marks those after a verb of speech in the clause;
* ``target`` decides which of them are aimed at someone: a target stands a few
  words before, or is promised and must come within a few words after.

The last three are composed into one grammar once.  Each arc has a factor, and
the weight of a match is its word's weight times the factors on its way.  A
clause scores what the best path through the grammar gathers, found by a search
that keeps at most BEAM states at each word.  What a document's clauses gather
in all, the best of them, and how many different insults matched go through a
logistic link, fitted on the same bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import runs
from leafmill.llm.common import id_and_text, map_batches, release, settle, sliced, strings, table

#: Labelled documents that are learnt from, at most: those whose hashed doc_id is least.
SAMPLE = 20_000
#: Arcs that a sample may propose, at most, most frequent first; bytes of a learnt word beginning.
PROPOSED, STEMS = 20_000, (4, 5, 6, 7, 8)
#: A learnt arc stands in so many sampled toxic documents at least, at so many times the rate in clean ones, with this G statistic.
SUPPORT, LIFT, SIGNIFICANCE = 5, 12.0, 20.0
THRESHOLD = 0.7
#: Words that a negation or a target reaches.
REACH = 3
#: States that the search keeps at each word.
BEAM = 16

INSULT, THREAT, TARGET, NEGATION, REPORT, WORD = "insult", "threat", "target", "negation", "report", "word"
SYMBOLS = (WORD, INSULT, THREAT, TARGET, NEGATION, REPORT)
LEXICON = {
    INSULT: "idiot moron imbecile scum trash garbage loser stupid pathetic worthless disgusting clown coward liar filth vermin dumb idiota imbécil basura estúpido cretino connard imbécile ordure stupide abruti dummkopf abschaum trottel blöd arschloch",
    THREAT: "kill hurt destroy beat stab shoot murder strangle matar tuer töten umbringen",
    TARGET: "you your yours he she him her they them tu ti usted ustedes él ella ellos vous toi il elle ils elles du dich dir ihr er sie ihn",
    NEGATION: "not never nobody nothing nunca jamás nadie pas jamais rien nicht nie kein keine niemand",
    REPORT: "said says wrote writes quoted quotes called calls reported claimed dijo dice escribió dit écrit sagte sagt schrieb nannte",
}
#: Factors of a match: aimed at someone, reached by a negation, reported.
AIMED, NEGATED, REPORTED = 1.5, 0.4, 0.4


@dataclass
class Transducer:
    """arcs[state][symbol]: (symbol written, factor, next state) of each arc. State 0 is where a clause starts; finals: where it may end."""

    arcs: list[dict[str, list[tuple[str, float, int]]]]
    finals: set[int]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what first reads and writes what second makes of first's output; factors multiply."""
    states, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
    while todo:
        a, b = todo.pop(0)
        out: dict[str, list[tuple[str, float, int]]] = {}
        for symbol, found in first.arcs[a].items():
            for middle, f, x in found:
                for written, g, y in second.arcs[b].get(middle, ()):
                    if (x, y) not in states:
                        states[x, y] = len(states)
                        todo.append((x, y))
                    out.setdefault(symbol, []).append((written, f * g, states[x, y]))
        arcs.append(out)
    return Transducer(arcs, {i for (a, b), i in states.items() if a in first.finals and b in second.finals})


def negation(reach: int = REACH, factor: float = NEGATED) -> Transducer:
    """State k > 0: a negation came k - 1 words ago."""
    arcs = []
    for k in range(reach + 1):
        after = (k + 1) % (reach + 1) if k else 0
        arcs.append({s: [(s, factor if k and s in (INSULT, THREAT) else 1.0, after)] for s in SYMBOLS} | {NEGATION: [(WORD, 1.0, 1)]})
    return Transducer(arcs, set(range(reach + 1)))


def report(factor: float = REPORTED) -> Transducer:
    """State 1: the clause holds a verb of speech."""
    arcs = [{s: [(s, factor if k and s in (INSULT, THREAT) else 1.0, k)] for s in SYMBOLS} | {REPORT: [(WORD, 1.0, 1)]} for k in (0, 1)]
    return Transducer(arcs, {0, 1})


def target(reach: int = REACH, factor: float = AIMED) -> Transducer:
    """State k <= reach: a target came k - 1 words ago (0: none).  State reach + k: one is promised since k - 1 words.

    A threat counts only if it is aimed.
    """
    arcs = []
    for k in range(2 * reach + 1):
        seen, promised = 0 < k <= reach, k > reach
        after = ((k + 1) % (reach + 1) if seen else 0) if not promised else k + 1
        lost = promised and k == 2 * reach  # the promised target didn't come
        out = {TARGET: [(TARGET, 1.0, 1)]}
        if not lost:
            out |= {s: [(WORD, 1.0, after)] for s in (WORD, NEGATION, REPORT)}
            if seen or promised:
                out |= {s: [(s, factor, after)] for s in (INSULT, THREAT)}
            else:
                out[INSULT] = [(INSULT, 1.0, after), (INSULT, factor, reach + 1)]
                out[THREAT] = [(WORD, 0.0, after), (THREAT, factor, reach + 1)]
        arcs.append(out)
    return Transducer(arcs, set(range(reach + 1)))


def grammar(aimed: float = AIMED, negated: float = NEGATED, reported: float = REPORTED) -> Transducer:
    return compose(compose(negation(factor=negated), report(reported)), target(factor=aimed))


def best_path(over: Transducer, clause: list[tuple[str, float]], beam: int = BEAM) -> tuple[float, list[str]]:
    """What the best path gathers over a clause of (symbol, weight), and the symbols that it writes."""
    held: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for symbol, weight in clause:
        after: dict[int, tuple[float, tuple]] = {}
        for state, (score, written) in held.items():
            for out, factor, to in over.arcs[state].get(symbol, ()):
                got = score + weight * factor
                if to not in after or got > after[to][0]:
                    after[to] = got, (written, out)
        held = after if len(after) <= beam else dict(sorted(after.items(), key=lambda x: (-x[1][0], x[0]))[:beam])
    score, path = max((held[s] for s in held if s in over.finals), key=lambda x: x[0], default=(0.0, ()))
    out: list[str] = []
    while path:
        path, symbol = path
        out.append(symbol)
    return score, out[::-1]


_QUOTES = re.compile("[“”„«»‘’…—–¿¡]")
_ENDS = np.array([chr(b) in ".!?;\n" for b in range(256)])


def spoken(text: str) -> bytes:
    """A text as the lexical transducer reads it: lower case, plain marks, n't as a word."""
    text = text.lower().replace("n't", " not")
    return (text if text.isascii() else _QUOTES.sub(lambda m: "." if m[0] == "…" else " ", text)).encode("utf-8", "replace")


class Lexical:
    """The lexical transducer as tables: words by 64-bit values, beginnings by their bytes.

    arcs: learnt words and beginnings (ending with *) with their weights.
    """

    def __init__(self, arcs: dict[str, float]):
        words = {w: (s, float(s in (INSULT, THREAT))) for s, listed in LEXICON.items() for w in listed.split()}
        stems: dict[int, dict[bytes, float]] = {}
        for arc, weight in arcs.items():
            if arc.endswith("*"):
                stems.setdefault(len(arc.encode()) - 1, {})[arc[:-1].encode()] = weight
            elif words.get(arc, (INSULT,))[0] in (INSULT, THREAT):
                words[arc] = words.get(arc, (INSULT,))[0], weight
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw])
        values = runs.word_units_at(b"".join(raw), np.append(0, ends[:-1]), ends)
        order = np.argsort(values)
        self.values = values[order]
        self.symbols = np.array([SYMBOLS.index(s) for s, _ in words.values()], np.int8)[order]
        self.weights = np.array([w for _, w in words.values()])[order]
        self.stems = []
        for n, held in sorted(stems.items()):
            keys = np.array([int.from_bytes(s, "little") for s in held], np.uint64)
            order = np.argsort(keys)
            self.stems.append((n, keys[order], np.array(list(held.values()))[order]))

    def read(self, text: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word of texts end to end: symbol (index in SYMBOLS), weight, clause, value; and the texts' bounds in words."""
        start, end = runs.word_spans(text, bounds, runs.LETTERS)
        one, two = runs.word_keys(text, start, end)
        value = runs.word_value(one, two)
        at = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
        known = self.values[at] == value
        symbol, weight = np.where(known, self.symbols[at], 0).astype(np.int8), np.where(known, self.weights[at], 0.0)
        size = end - start
        for n, keys, weights in self.stems:
            head = one & np.uint64((1 << 8 * n) - 1)
            at = np.minimum(np.searchsorted(keys, head), len(keys) - 1)
            hit = (keys[at] == head) & (size >= n) & (symbol <= 1) & (weights[at] > weight)
            symbol[hit], weight[hit] = 1, weights[at[hit]]
        if len(text):
            breaks = np.append(0, np.cumsum(_ENDS[np.frombuffer(text, np.uint8)]))
            clause = breaks[start] + np.searchsorted(bounds, start, side="right")  # a text begins a clause
        else:
            clause = np.empty(0, np.int64)
        return symbol, weight, clause, value, np.searchsorted(start, bounds)


def evidence(texts: list[str], lexical: Lexical, over: Transducer) -> np.ndarray:
    """Of each text: what its clauses gather in all, what the best one gathers, and how many different insults match."""
    out = np.zeros((len(texts), 3))
    for first, _, joined, bounds in runs.joined([spoken(t) for t in texts]):
        symbol, weight, clause, value, words = lexical.read(joined, bounds)
        struck = np.flatnonzero((symbol == 1) | (symbol == 2))
        if not len(struck):
            continue
        marked = np.flatnonzero(symbol)
        marked = marked[np.isin(clause[marked], clause[struck])]
        text = np.searchsorted(words, marked, side="right") - 1
        cuts = np.flatnonzero((clause[marked][1:] != clause[marked][:-1]) | (text[1:] != text[:-1])) + 1
        for part in np.split(np.arange(len(marked)), cuts):
            read, last = [], None
            for i in marked[part].tolist():
                if last is not None:  # more words than anything reaches over are one too many as well
                    read += [(WORD, 0.0)] * min(i - last - 1, REACH + 1)
                read.append((SYMBOLS[symbol[i]], float(weight[i])))
                last = i
            score, _ = best_path(over, read)
            d = first + int(text[part[0]])
            out[d, 0] += score
            out[d, 1] = max(out[d, 1], score)
        struck = struck[symbol[struck] == 1]
        owner = np.searchsorted(words, struck, side="right") - 1
        pairs = np.unique(np.column_stack([owner, value[struck].view(np.int64)]), axis=0)
        np.add.at(out[:, 2], first + pairs[:, 0], 1)
    return out


def features(rows: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), np.log1p(np.asarray(rows, float).reshape(-1, 3))])


def scores(texts: list[str], lexical: Lexical, over: Transducer, link: list[float]) -> np.ndarray:
    x = features(evidence(texts, lexical, over))
    return 1 / (1 + np.exp(-np.clip(x @ np.array(link), -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text and toxic (0, 1) of at most ``most`` labelled documents that aren't held out; of several texts under one doc_id the least, and copies once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return id_and_text(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").dropDuplicates()


def proposed(sample: DataFrame) -> list[tuple[str, int, int, float]]:
    """(arc, toxic, clean, weight) of the words and beginnings that mark toxic documents; weight is the log of the rates' ratio."""

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        tally = (Counter(), Counter())
        for text, toxic in zip(strings(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            raw = spoken(text)
            start, end = runs.word_spans(raw, np.array([0, len(raw)]), runs.LETTERS)
            words = {raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)}
            stems = {w[:n] + b"*" for w in words for n in STEMS if len(w) > n and w[n] & 0xC0 != 0x80}
            tally[toxic].update(words | stems)
            tally[toxic][b""] += 1
        both = list(tally[0].keys() | tally[1].keys())
        yield {"arc": both, "clean": [tally[0][a] for a in both], "toxic": [tally[1][a] for a in both]}

    rows = map_batches(sample, "arc binary,clean long,toxic long", count).groupBy("arc").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = settle(rows.where(f"toxic >= {SUPPORT} or octet_length(arc) = 0"))
    total = rows.where("octet_length(arc) = 0").first()
    clean, toxic = (total["clean"], total["toxic"]) if total else (0, 0)
    lift = (F.col("toxic") + 0.5) / (toxic + 1.0) / ((F.col("clean") + 0.5) / (clean + 1.0))
    expected = (F.col("toxic") + F.col("clean")) * (toxic / max(1, clean + toxic))
    g = 2 * F.col("toxic") * F.log(F.col("toxic") / F.greatest(expected, F.lit(1e-9)))
    found = rows.where("octet_length(arc) > 0").where((F.col("toxic") >= SUPPORT) & (lift >= LIFT) & (g >= SIGNIFICANCE)).select("arc", "toxic", "clean", F.log(lift).alias("weight"))
    out = [(bytes(r["arc"]).decode("utf-8", "replace"), r["toxic"], r["clean"], r["weight"]) for r in found.orderBy(F.desc("toxic"), "arc").limit(PROPOSED).collect()]
    release(rows)
    return out


def chosen(found: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """The arcs that are kept of those proposed.

    A beginning is kept only if it goes on in different ways: no word or longer
    beginning under it stands in nine tenths of its toxic documents.  What lies
    under a kept beginning and says little more is left out.
    """
    toxic = {arc: n for arc, n, _, _ in found}
    weight = {arc: w for arc, _, _, w in found}
    most: Counter = Counter()
    for arc, n in toxic.items():
        bare = arc.rstrip("*")
        for k in range(1, len(bare) + (arc == bare)):
            most[bare[:k]] = max(most[bare[:k]], n)
    kept: dict[str, float] = {}
    for arc in sorted(toxic, key=lambda a: (len(a.rstrip("*")), not a.endswith("*"), a)):
        bare = arc.rstrip("*")
        if arc.endswith("*") and most[bare] >= 0.9 * toxic[arc]:
            continue
        if not any(kept.get(bare[:k] + "*", -math.inf) >= weight[arc] - 0.7 for k in range(1, len(bare) + 1)):
            kept[arc] = weight[arc]
    return kept


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the constant is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = ridge * np.eye(len(w))
    shrink[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]]:
    """Arcs and link weights, from the bounded sample."""
    sample = settle(sample_of(docs, labels))
    arcs, over = chosen(proposed(sample)), grammar()

    def read(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"toxic": batch.column("toxic"), "m": evidence(strings(batch.column("text")), Lexical(arcs), over).tolist()}

    # Equal rows are counted, so the driver gets at most SAMPLE short ones.
    rows = map_batches(sample, "toxic int,m array<double>", read).groupBy("toxic", "m").count().collect()
    release(sample)
    if not rows:
        return arcs, [math.log(0.01), 0.0, 0.0, 0.0]
    n = [r["count"] for r in rows]
    x = np.repeat(features(np.array([r["m"] for r in rows])), n, axis=0)
    return arcs, fit(x, np.repeat([float(r["toxic"]) for r in rows], n)).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Operator 2's contract: doc_id, held_out, score, predicted.

    Scores see nothing but the text.  A null text is empty and gets an empty
    text's score; bytes that are not valid UTF-8 read as U+FFFD; a null doc_id
    is never held out; rows that repeat are scored each.  Without labels every
    document gets 0.01.  An empty table has no rows.
    """
    arcs, link = learn(docs, labels)
    over = grammar()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexical = Lexical(arcs)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(strings(batch.column(1)), lexical, over, link))], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(score, "doc_id long,score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores as toxic; all columns are kept.

    A null text is scored as an empty one; rows without a doc_id and rows that
    repeat are scored each by their text; an empty table stays empty.
    """
    arcs, link = learn(docs, labels)
    over = grammar()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexical = Lexical(arcs)
        for batch in sliced(batches):
            texts = strings(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(scores(texts, lexical, over, link) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
