"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests takes for keys."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: These ask for the least length at once: a run that is too short has no longer part of its kind.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
#: False discoveries among a document's random spans.
FDR = 0.01

ALPHABETS = (("hex", re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z"), 16), ("base32", re.compile(r"[A-Z2-7]+=*\Z"), 32), ("alnum", re.compile(r"[A-Za-z0-9]+\Z"), 62), ("base64", re.compile(r"[A-Za-z0-9+/_-]+=*\Z"), 64))


def encoding_of(token: str) -> tuple[str, int]:
    """The smallest alphabet that holds the token, and its size."""
    return next(((name, size) for name, pattern, size in ALPHABETS if pattern.match(token)), ("base64", 64))


def _upper(z: float) -> float:
    """P(normal > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(token: str, size: int) -> float:
    """P of so uneven counts if characters are uniform over the alphabet (Wilson-Hilferty).

    With fewer than five characters for each cell the alphabet is folded to fewer cells.
    """
    cells = max(2, min(size, len(token) // 5))
    counts = Counter(_rank(c) * cells // 64 for c in token) if size > 16 else Counter(_hex_rank(c) * cells // 16 for c in token)
    share = Counter(_rank(c) * cells // 64 for c in _letters(size)) if size > 16 else Counter(_hex_rank(c) * cells // 16 for c in "0123456789abcdef")
    total, n = sum(share.values()), len(token)
    stat = sum((counts[k] - n * v / total) ** 2 / (n * v / total) for k, v in share.items())
    df = max(1, len(share) - 1)
    return _upper(((stat / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def _letters(size: int) -> str:
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return {32: upper + "234567", 62: upper + lower + digits, 64: upper + lower + digits + "+/"}[size]


_RANK = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {"-": 62, "_": 63}


def _rank(c: str) -> int:
    # spread neighbours in the alphabet over cells, else classes of letters fill whole cells
    return _RANK.get(c, 0) * 37 % 64


def _hex_rank(c: str) -> int:
    return int(c, 16) * 7 % 16


def runs_test(values: list[int]) -> float:
    """Two-sided P of the number of runs above and below the median (Wald-Wolfowitz)."""
    middle = sorted(values)[len(values) // 2]
    side = [v >= middle for v in values]
    a = sum(side)
    b = len(side) - a
    if not a or not b:
        return 0.0
    runs = 1 + sum(x != y for x, y in zip(side, side[1:], strict=False))
    mean, n = 1 + 2 * a * b / (a + b), a + b
    var = (mean - 1) * (mean - 2) / (n - 1)
    return 2 * _upper(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_correlation(values: list[int]) -> float:
    """Two-sided P of the correlation of neighbours."""
    n, mean = len(values), sum(values) / len(values)
    var = sum((v - mean) ** 2 for v in values)
    if not var:
        return 0.0
    r = sum((x - mean) * (y - mean) for x, y in zip(values, values[1:], strict=False)) / var
    return 2 * _upper(abs(r + 1 / n) * math.sqrt(n))


#: Letters in English prose, per thousand.
PROSE = dict(zip("abcdefghijklmnopqrstuvwxyz", (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 0.95, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.74), strict=True))
#: Log odds of a letter in prose over a uniform one, with their mean and deviation in prose.
ODDS = {c: math.log(26 * f / sum(PROSE.values())) for c, f in PROSE.items()}
ODDS_MEAN = sum(f * ODDS[c] for c, f in PROSE.items()) / sum(PROSE.values())
ODDS_DEV = math.sqrt(sum(f * (ODDS[c] - ODDS_MEAN) ** 2 for c, f in PROSE.items()) / sum(PROSE.values()))


def class_changes(token: str) -> int:
    """Changes of class (case, digits, others); a capital or a single separator that starts a word counts once."""
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in token]
    changes = 0
    for i, (x, y) in enumerate(zip(kind, kind[1:], strict=False)):
        before = kind[i - 1] if i else 3
        starts = before != x and ((x == 1 and y == 0) or (x == 3 and i > 0))
        changes += x != y and not starts
    return changes


#: Chance that two letters of prose are equal, and that a word's next letter is of another class; correlation of
#: neighbours, vowel or not, in prose.
PAIR, CHANGE, VOWELS = 0.065, 0.125, -0.25


def battery(token: str) -> tuple[tuple[float, float], ...]:
    """The three tests on a token: of each, z of the statistic against words, and P against its encoding's random strings.

    Chi-squared: counts as even as a random string's have few equal pairs (the statistic is their number, but for
    scale) and rare letters as often as common ones, both unlike words. Runs: a random string changes its class (case, digit)
    from letter to letter, words seldom do. Serial correlation: in words vowels and others take turns. Under words
    each z is normal; its mean and deviation follow from the length, so evidence grows with it.
    """
    bare = token.rstrip("=")
    n, low, size = len(bare), bare.lower(), encoding_of(token)[1]
    pairs, equal = n * (n - 1) / 2, sum(c * (c - 1) / 2 for c in Counter(low).values())
    even = (PAIR * pairs - equal) / math.sqrt(pairs * PAIR * (1 - PAIR) + n * n * n * 0.0006)
    letters = [ODDS[c] for c in low if c in ODDS]
    rare = (ODDS_MEAN * len(letters) - sum(letters)) / (ODDS_DEV * math.sqrt(len(letters))) if letters else 0.0
    runs = (class_changes(bare) - CHANGE * (n - 1)) / math.sqrt((n - 1) * CHANGE * (1 - CHANGE))
    vowels = [c in "aeiouy" for c in low if c in ODDS]
    mean = sum(vowels) / max(1, len(vowels))
    turns = sum((x - mean) * (y - mean) for x, y in zip(vowels, vowels[1:], strict=False)) / (len(vowels) * mean * (1 - mean)) if 0 < mean < 1 else VOWELS
    serial = (turns - VOWELS) * math.sqrt(len(vowels)) if vowels else 0.0
    values = [_hex_rank(c) if size == 16 else _rank(c) for c in bare]
    return ((even + rare) / math.sqrt(2), chi_squared(bare, size)), (runs, runs_test(values)), (serial, serial_correlation([_RANK.get(c, 0) for c in bare]))


#: Weight of the serial test against words, the weakest one; from which P on a test against random strings says nothing.
SERIAL, DOUBT = 0.7, 0.2


def token_p(token: str) -> float:
    """One P for a token, from the battery: of words looking so random, raised where a test says that the token is no random string.

    The z against words are summed. Three times the least P against random strings is a P of all three; where it is under DOUBT,
    its normal quantile, less that of DOUBT, is added: for a random string seldom and little, for a sequence or a repetition so
    far down that no evidence against words outweighs it. Adding what is never positive only raises P, so P is valid.
    """
    (chi, p1), (runs, p2), (serial, p3) = battery(token)
    z = (chi * math.sqrt(2) + runs + SERIAL * serial) / math.sqrt(3 + SERIAL**2)
    quantile = NormalDist().inv_cdf
    return _upper(z + quantile(max(1e-12, min(3 * min(p1, p2, p3), DOUBT))) - quantile(DOUBT))


def random_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens outside the taken spans that pass for keys, with false discoveries held by Benjamini and Hochberg.

    The family is all candidate tokens of the document. Its error is dealt out by length: a token's P is divided by its length
    over the family's mean length, so weights have a mean of one and the rate of false discoveries holds, while
    short tokens, that can show little, take little of it.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            found.append((m.start(), m.end(), token_p(m.group())))
    mean = sum(b - a for a, b, _ in found) / max(1, len(found))
    found = sorted((p * mean / (b - a), a, b) for a, b, p in found)
    last = max((i for i, x in enumerate(found, 1) if x[0] <= FDR * i / len(found)), default=0)
    return sorted((a, b) for _, a, b in found[:last])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, leftmost and non-overlapping within a kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6] if ":" in text or "=" in text else []
    out += [("access", *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, by start and then kind."""
    base = base_spans(text)
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    more = [("random", a, b) for a, b in random_spans(text, [(a, b) for _, a, b in base])]
    return sorted(base, key=key), sorted(base + more, key=key)


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, spans = all_spans(text or "")
            n = Counter(k for k, _, _ in base)
            rows.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        cols, types = list(zip(*rows, strict=True)) or [[]] * 6, [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


@small_batches
def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in every text: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, ...).

    One row per input row; null counts as empty and has no spans. Offsets are code points, ends exclusive. Ids are
    whole numbers (cast to bigint; others become null).
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return secret_scan(table(spark, sf_dir, "documents"))
