"""Secret scans: pattern candidates, then a random forest that removes false positives.

Candidates are prefixed keys, private key blocks with or without their end, values assigned to names such as ``password`` or ``token``, and long mixed strings with
digits.  The forest looks at length, changes of character class, dictionary coverage, path shape and the words around, and is trained from
labelled findings: by default those that ``labelled_findings`` makes from stated shapes of secrets and of look-alikes; a table of reviewed
findings with the same columns takes its place.

The dictionary is COMMON and the corpus's own frequent words: whole words of letters that stand in at least WORD_DOCUMENTS documents, counted over
all documents; if they are more than DICTIONARY_WORDS, those above the lowest number of documents (in steps of a sixteenth of an octave) that leaves
no more.  A string with a digit or a sign gives no word, so secrets do not enter it.

Values and mixed strings have no upper length.  A long one that the forest refuses as a whole is looked into, so it hides no secret inside it.

A batch of texts first goes through one compiled search for what any candidate must hold; only texts that pass are scanned further.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import arrow_text as at
from lamina.llm import forest
from lamina.llm.common import bounded, deleted, written
from lamina.llm.text_stats import fresh

#: Fixed formats of keys by issuer.
PREFIXED = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
NAMES = r"password|passwd|pwd|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|credential|bearer"
_HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
#: A key whose end is missing goes on for lines of base64, after lines of headers; a short last line must not look like a word.
_OPEN = r"(?:(?:\s|\\[nr])*+[A-Z][0-9A-Za-z-]*+: [^\n]*+)*+(?:\s|\\[nr])*+(?=[a-z]*+[0-9A-Z+/])[0-9A-Za-z+/=]{16,}+(?:(?:\s|\\[nr])++(?:[0-9A-Za-z+/=]{40,}+|(?=[A-Za-z]*+[0-9+/=])[0-9A-Za-z+/=]++))*+"
BLOCK = rf"{_HEAD}(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|{_OPEN})"
_ASSIGN = rf"(?i:{NAMES})[\"']?\s{{0,3}}(?:[:=]|\s)\s{{0,3}}(?P<quote>[\"']?)"
_MIXED = r"(?<![0-9A-Za-z+/_=-])(?P<mixed>(?=[A-Za-z+/_=-]*+[0-9])[0-9A-Za-z+/_=-]{16,}+)"
_PREFIXED = rf"\b(?P<prefixed>{PREFIXED})(?![0-9A-Za-z])"
CANDIDATES = re.compile(rf"(?P<block>{BLOCK})|{_PREFIXED}|{_ASSIGN}(?P<assigned>[^\s\"']{{6,}}+)(?P=quote)|{_MIXED}")
#: What is searched inside a refused candidate of more than LONG characters: a value ends before the next name that has one.
INNER = re.compile(rf"{_PREFIXED}|{_ASSIGN}(?P<assigned>(?:(?!(?i:{NAMES})[:=])[^\s\"']){{6,}}+)(?P=quote)|{_MIXED}")
LONG = 200
#: What a text must hold to hold a candidate; searched without backtracking.
MAY_HOLD = rf"(?i:{NAMES})|-----BEGIN |AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|[0-9][0-9A-Za-z+/_=-]{{7}}|[0-9A-Za-z+/_=-]{{8}}[0-9]"
#: Fixed words: names that go before secrets, and words that go before harmless look-alikes.
HOT_WORDS = frozenset("password passwd pwd passphrase secret token api key apikey access auth credential credentials bearer aws private".split())
COLD_WORDS = frozenset("commit sha md5 sha1 sha256 checksum digest hash uuid guid id version build revision example sample placeholder card phone isbn order ticket serial file path url".split())
#: Fixed words that look-alikes are made of.
COMMON = tuple(
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use name user main test data file code list item type time page view form text date book home work road line view node path host port site mail info admin login example change your here value string number index table config server client service account customer default sample token password secret key access hello world welcome summer winter spring autumn monday friday".split()
)
#: How many words of the corpus the dictionary takes, in how many documents each must stand, and how long they are.
DICTIONARY_WORDS, WORD_DOCUMENTS, WORD_LENGTHS = 20_000, 10, (4, 12)
_DICTIONARY = frozenset(COMMON)
FEATURES = ("length", "changes", "digit", "upper", "lower", "other", "entropy", "coverage", "slashes", "dots", "dashes", "hot_before", "cold_before", "assigned", "quoted", "hex", "digits_only", "uuid", "prefixed", "repeats")
CUT, CONTEXT = 0.5, 48
FINDING = T.StructType([T.StructField("begin", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("kind", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_WORD = re.compile(r"[a-z]{3,}")


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3


def _coverage(text: str, words: frozenset[str]) -> float:
    """The share of letters inside dictionary words, found greedily."""
    low, covered, i = text.lower(), 0, 0
    while i < len(low):
        n = next((k for k in range(min(WORD_LENGTHS[1], len(low) - i), 2, -1) if low[i : i + k] in words), 0)
        covered += n
        i += n or 1
    return covered / max(1, sum(c.isalpha() for c in low))


def frequent_words(texts: DataFrame, text_col: str = "text") -> frozenset[str]:
    """COMMON and the frequent words of the texts, in lower case; at most DICTIONARY_WORDS and a thousand counts of words reach the driver."""
    word = rf"(?<![^\x20\x09-\x0D])[a-z]{{{WORD_LENGTHS[0]},{WORD_LENGTHS[1]}}}(?=[.,;:!?]?(?:[\x20\x09-\x0D]|$))"
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(word), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WORD_DOCUMENTS)
    counts = written(counts.select("word", F.floor(16 * F.log2("n")).cast("int").alias("step")), "words")
    floor, total = 0, 0
    for step, n in sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):
        if total + n > DICTIONARY_WORDS:
            floor = step + 1
            break
        total += n
    found = _DICTIONARY | {r["word"] for r in counts.where(F.col("step") >= floor).select("word").collect()}
    deleted(texts.sparkSession, counts)
    return found


def features(candidate: str, before: str, after: str, dictionary: frozenset[str] = _DICTIONARY) -> list[float]:
    """before, after: what surrounds the candidate, at most CONTEXT characters."""
    n = max(1, len(candidate))
    kinds = [_kind(c) for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    entropy = -sum(p * math.log2(p) for p in (candidate.count(c) / n for c in set(candidate)))
    near = before.lower().rstrip()
    words = re.findall(r"[a-z0-9]+", near)[-3:]
    return [
        n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, *share, entropy, _coverage(candidate, dictionary), candidate.count("/"), candidate.count("."), candidate.count("-"),
        float(any(w in HOT_WORDS for w in words)), float(any(w in COLD_WORDS for w in words)), float(near[-1:] in (":", "=") or near[-2:-1] in (":", "=")), float(before[-1:] in ("'", '"')),
        float(re.fullmatch(r"[0-9a-fA-F]+", candidate) is not None), float(candidate.isdigit()), float(_UUID.fullmatch(candidate) is not None), float(re.match(PREFIXED, candidate) is not None),
        1 - len(set(candidate)) / n,
    ]


def labelled_findings(n: int = 3000, seed: int = 11, dictionary: frozenset[str] = _DICTIONARY) -> Iterable[tuple[str, str, str, int]]:
    """n findings (candidate, before, after, label), half of them secrets, made from stated shapes; look-alikes of words take the dictionary's."""
    rng, rest = random.Random(seed), sorted(dictionary.difference(COMMON))
    hexa, upper, full = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda of, k: "".join(rng.choice(of) for _ in range(k))
    word = lambda: rng.choice(rest if rest and rng.random() < 0.5 else COMMON)
    prose = lambda: " ".join(some("etaoinshrdlucm", rng.randint(2, 9)) for _ in range(5)) + " "
    name = lambda: rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_key", "bearer"])
    sign = lambda: rng.choice(["=", " = ", ": ", ":"])
    for i in range(n):
        quote = rng.choice(["", "", '"', "'"])
        if i % 2:
            shape = rng.randrange(7)
            if shape == 0:
                found, before = "AKIA" + some(upper, 16), prose() + rng.choice(["", "key ", "aws_access_key_id="])
            elif shape == 1:
                found, before = "ghp_" + some(full, 36), prose()
            elif shape in (2, 3):
                found, before = some(hexa, rng.choice([16, 18, 24, 32, 40, 64])), prose() + name() + sign() + quote
            elif shape == 4:
                found, before = some(full + "+/", rng.randint(20, 64)), prose() + name() + sign() + quote
            elif shape == 5:
                found, before = some(full + "!@#%^&*", rng.randint(8, 20)), prose() + rng.choice(["password", "pwd", "passwd"]) + sign() + quote
            else:
                found, before = "eyJ" + some(full, 30) + ".eyJ" + some(full, 60) + "." + some(full, 40), prose() + "bearer "
            yield found, before[-CONTEXT:], quote + " " + prose(), 1
        else:
            shape = rng.randrange(11)
            before, after = prose(), " " + prose()
            if shape == 0:
                found, before = "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), before + rng.choice(["uuid ", "id=", "id: ", ""])
            elif shape == 1:
                found, before = some(hexa, rng.choice([32, 40, 64])), before + rng.choice(["commit ", "sha1 ", "md5 ", "checksum: ", "digest "])
            elif shape == 2:
                found = "/".join([word() for _ in range(rng.randint(3, 6))]) + some("0123456789", 3)
            elif shape == 3:
                found, before = some("0123456789", rng.randint(16, 20)), before + rng.choice(["", "card ", "order ", "id "])
            elif shape == 4:
                found = "_".join(word() for _ in range(rng.randint(3, 5))) + some("0123456789", rng.randint(1, 4))
            elif shape == 5:
                found, before = word() + word() + rng.choice(["", "123"]), before + name() + sign() + quote
            elif shape == 6:
                found, before = rng.choice(["x" * 12, "*" * 10, "<your-token-here>", "your_password", "changeme", "${TOKEN}", "example-password", "None,", "required"]), before + name() + sign() + quote
            elif shape == 7:
                found, before = some("etaoinshrdlucm", rng.randint(6, 12)) + rng.choice(["", ".", ","]), before + name() + " "
            elif shape == 8:
                found = f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}"
            elif shape == 9:
                found = "".join(word().capitalize() for _ in range(rng.randint(3, 5))) + some("0123456789", 2)
            else:
                found = some("etaoinshrdlucmETAOINSHR", rng.randint(14, 30)) + some("0123456789", 1)
            yield found, before[-CONTEXT:], after[:CONTEXT], 0


def trained(findings: Iterable[tuple[str, str, str, int]] | None = None, dictionary: frozenset[str] = _DICTIONARY) -> forest.Forest:
    rows = list(labelled_findings(dictionary=dictionary) if findings is None else findings)
    return forest.train(np.array([features(c, b, a, dictionary) for c, b, a, _ in rows], float).reshape(-1, len(FEATURES)), np.array([r[3] for r in rows], float))


@functools.lru_cache(maxsize=8)
def default_forest(dictionary: frozenset[str] = _DICTIONARY) -> forest.Forest:
    return trained(dictionary=dictionary)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the candidates in order; they do not overlap."""
    return [(*m.span(m.lastgroup), m.lastgroup) for m in CANDIDATES.finditer(text)]


def _inside(text: str, begin: int, end: int, kind: str) -> list[tuple[int, int, str]]:
    """The candidates inside a refused one, in order."""
    spans = ((*m.span(m.lastgroup), m.lastgroup) for m in INNER.finditer(text, begin + (kind == "mixed"), end))
    return [s for s in spans if s[:2] != (begin, end)]


def scan(texts: list[str], model: forest.Forest, dictionary: frozenset[str] = _DICTIONARY) -> list[list[tuple[int, int, str, float]]]:
    """All candidates of each text with their scores; in place of a long refused one that holds others, those."""
    found = _scored(texts, [candidates(t) for t in texts], model, dictionary)
    while inner := {(i, b): more for i, of in enumerate(found) for b, e, kind, score in of if score < CUT and e - b > LONG and (more := _inside(texts[i], b, e, kind))}:
        scored = dict(zip(inner, _scored([texts[i] for i, _ in inner], list(inner.values()), model, dictionary), strict=True))
        found = [[x for c in of for x in scored.get((i, c[0]), [c])] for i, of in enumerate(found)]
    return found


def _scored(texts: list[str], found: list[list[tuple[int, int, str]]], model: forest.Forest, dictionary: frozenset[str]) -> list[list[tuple[int, int, str, float]]]:
    rows = [features(t[b:e], t[max(0, b - CONTEXT) : b], t[e : e + CONTEXT], dictionary) for t, of in zip(texts, found, strict=True) for b, e, _ in of]
    scores = iter(model.score(np.array(rows, float).reshape(-1, len(FEATURES))))
    return [[(b, e, kind, max(float(next(scores)), float(kind == "block"))) for b, e, kind in of] for of in found]


def scanned(docs: DataFrame, model: forest.Forest | None = None, text_col: str = "text", redact: bool = False, dictionary: frozenset[str] | None = None) -> DataFrame:
    """docs with two more columns: the number of candidates, and the findings kept as (begin, end, kind, score) in code points, in order.

    model, dictionary: a forest and the words that it was trained with; without a forest the texts' own frequent words train one.
    redact: each finding's text becomes ``[SECRET]`` in the text column, and a column n_chars follows the new length.
    Null texts stay null and have no candidates."""
    bounded(docs.sparkSession)
    if dictionary is None:
        dictionary = _DICTIONARY if model else frequent_words(docs, text_col)
    model = model or default_forest(dictionary)
    n_name, f_name = fresh(docs, "n_candidates"), fresh(docs, "findings")
    schema = T.StructType([*docs.schema.fields, T.StructField(n_name, T.LongType(), False), T.StructField(f_name, T.ArrayType(FINDING, False), False)])

    def run(batches):
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            texts = at.column(batch, text_col)
            some = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, MAY_HOLD)))
            held = texts.take(pa.array(some)).to_pylist()
            n, kept = np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
            for i, of in zip(some, scan(held, model, dictionary), strict=True):
                n[i] = len(of)
                kept[i] = [{"begin": b, "end": e, "kind": k, "score": s} for b, e, k, s in of if s >= CUT]
            columns = list(batch.columns)
            if redact and any(kept):
                change = {i: _redacted(t, kept[i]) for i, t in zip(some, held, strict=True) if kept[i]}
                columns = _replaced(batch, columns, text_col, change)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(kept, kind)], names=[*batch.schema.names, n_name, f_name])

    return docs.mapInArrow(run, schema)


def _redacted(text: str, findings: list[dict]) -> str:
    out, last = [], 0
    for f in findings:
        out += [text[last : f["begin"]], "[SECRET]"]
        last = f["end"]
    return "".join(out) + text[last:]


def _replaced(batch: pa.RecordBatch, columns: list, text_col: str, change: dict[int, str]) -> list:
    i = batch.schema.get_field_index(text_col)
    mask = np.zeros(batch.num_rows, bool)
    mask[list(change)] = True
    columns[i] = pc.replace_with_mask(columns[i], pa.array(mask), pa.array([change[k] for k in sorted(change)], columns[i].type))
    j = batch.schema.get_field_index("n_chars")
    if j >= 0 and pa.types.is_integer(columns[j].type):
        columns[j] = pc.replace_with_mask(columns[j], pa.array(mask), pa.array([len(change[k]) for k in sorted(change)], columns[j].type))
    return columns


def report(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_candidates, n_secrets and the findings."""
    return scanned(documents.select("doc_id", "text")).selectExpr("doc_id", "n_candidates", "cast(size(findings) as long) n_secrets", "findings")


def redacted(documents: DataFrame) -> DataFrame:
    """documents with every secret replaced; no row goes.  n_chars follows the text if it is a column of integers, else it stays."""
    return scanned(documents, redact=True).select(*documents.columns)
