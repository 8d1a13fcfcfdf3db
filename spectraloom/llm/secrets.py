"""Secret scans: fixed patterns plus strings that pass a battery of randomness tests.

Patterns: an assignment to a password-like name, an access key id, a long run of hex digits.
Beyond those, every run of 20 or more key characters whose inferred encoding is one of `ALPHABETS`
is tested for randomness in that encoding: chi-squared uniformity over the alphabet, runs above and
below the middle, serial correlation at lag one. Fisher's method joins the three p-values.
A run that mixes "+" or "/" with "-" or "_" fits no alphabet; it is split at the one pair and at the other,
and every part of 20 or more characters is tested. Parts that overlap are reported as one span.

False-discovery control is length-aware: runs are grouped by encoding and length, since the tests
gain power with length. In a group, random strings have uniform p-values and ordinary ones crowd at
small values; the share above one half tells how many are random. The group's limit is the smallest
p at which runs beyond it exceed that expectation by at most the rate `fdr`. Every distinct run counts
once, so copies of a text change no limit. Limits need one pass over the data, in which each task keeps
one 64-bit hash of a run with its encoding, group and bin; the hashes are made distinct by a shuffle and
counted in bins (a bounded table). The spans need a second pass without a shuffle.

Cases: a NULL text is empty and has no spans; offsets are code points, end exclusive; repeated rows
get the same spans; a run that overlaps a pattern's span is not reported again; an empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .names import free_name

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
PARTS = (re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9_-]{20,}"))

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: from the narrowest; a run belongs to the first that holds all its characters
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}
CODES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
LENGTHS = (24, 32, 48, 96)
BINS = 100
LEVEL = 0.01
PRIOR = 100.0
#: distinct runs a task holds, and rows it sends at once
HELD_RUNS = 200_000
RUN_ROWS = 10_000


def encoding_of(run):
    """Name of the inferred encoding; None for plain words and plain numbers."""
    chars = set(run)
    has_digit = not chars.isdisjoint(DIGITS)
    inner_case = run.lower() != run and run.upper() != run and not run.istitle()
    if not (has_digit or inner_case) or chars <= set(DIGITS):
        return None
    return next((name for name, letters in SETS.items() if chars <= letters), None)


def _normal_tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run, encoding):
    """p-value of the joint test that `run` is random over its alphabet; near 0 for ordinary strings."""
    code = CODES[encoding]
    x = [code[c] for c in run]
    n, k = len(x), len(code)
    counts = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    df = k - 1
    p_uniform = _normal_tail(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
    high = [v * 2 >= k for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(high[i] != high[i - 1] for i in range(1, n))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    mid = sum(x) / n
    spread = sum((v - mid) ** 2 for v in x)
    serial = sum((x[i] - mid) * (x[i - 1] - mid) for i in range(1, n)) / spread if spread else 1.0
    p_serial = 2 * _normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    return math.exp(-fisher / 2) * (1 + fisher / 2 + fisher * fisher / 8)


def length_group(n):
    return sum(n >= edge for edge in LENGTHS)


def _parts(text, start, end):
    """(start, end) of what is tested of a run: itself, or its parts if it mixes separators of two alphabets."""
    run = text[start:end]
    if ("+" in run or "/" in run) and ("-" in run or "_" in run):
        return sorted({m.span() for part in PARTS for m in part.finditer(text, start, end)})
    return [(start, end)]


def tested_runs(text):
    """(start, end, encoding, length group, p) of every testable run or part of one."""
    for m in RUN.finditer(text):
        for start, end in _parts(text, m.start(), m.end()):
            encoding = encoding_of(text[start:end])
            if encoding:
                yield start, end, encoding, length_group(end - start), battery(text[start:end], encoding)


def base_spans(text):
    """(start, kind index, end) of the fixed patterns, in order."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    # access keys and hex strings lie inside runs of key characters
    for run in RUN.finditer(text):
        at = run.start()
        spans += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(run[0]) if len(m[0]) >= 20]
        spans += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run[0])]
    return sorted(spans)


def all_spans(text, limits):
    """Base spans and the runs declared random under `limits`, by start, kind."""
    base = base_spans(text)
    more = []
    for start, end, encoding, group, p in tested_runs(text):
        if p >= limits.get((encoding, group), LEVEL) and not any(s < end and start < e for s, _, e in base):
            if more and start < more[-1][2]:
                more[-1] = (more[-1][0], 3, max(end, more[-1][2]))
            else:
                more.append((start, 3, end))
    return base, sorted(base + more)


def limits_of(counts, fdr=0.05):
    """p limit of each (encoding, group) from counts {(encoding, group, bin): n}.

    `PRIOR` uniform p-values are added to each group, so that few runs do not decide alone.
    """
    out = {}
    for key in {k[:2] for k in counts}:
        n = [counts.get((*key, b), 0) for b in range(BINS)]
        random = 2 * sum(n[BINS // 2 :]) + PRIOR
        for b in range(max(1, round(LEVEL * BINS)), BINS // 2 + 1):
            t = b / BINS
            found = sum(n[b:]) + PRIOR * (1 - t)
            if 1 - (1 - t) * random / found <= fdr or b == BINS // 2:
                out[key] = t
                break
    return out


def random_limits(docs, text="text", fdr=0.05):
    """Limits from all distinct runs of `docs`; the counts are at most alphabets x lengths x bins rows."""

    def work(batches):
        held = set()

        def flush():
            rows = list(held)
            held.clear()
            for i in range(0, len(rows), RUN_ROWS):
                h, e, g, b = zip(*rows[i : i + RUN_ROWS])
                yield pa.RecordBatch.from_pydict(
                    {"h": pa.array(h, pa.int64()), "e": e, "g": pa.array(g, pa.int32()), "b": pa.array(b, pa.int32())}
                )

        for batch in batches:
            for value in batch.column(0).to_pylist():
                value = value or ""
                for start, end, encoding, group, p in tested_runs(value):
                    digest = hashlib.blake2b(value[start:end].encode(), digest_size=8).digest()
                    held.add((int.from_bytes(digest, "little", signed=True), encoding, group, min(int(p * BINS), BINS - 1)))
                if len(held) >= HELD_RUNS:  # beyond this, the shuffle finds the copies
                    yield from flush()
        yield from flush()

    runs = docs.select(text).mapInArrow(work, "h bigint, e string, g int, b int").distinct()
    rows = runs.groupBy("e", "g", "b").agg(F.count("*").alias("n")).collect()
    return limits_of({(r.e, r.g, r.b): r.n for r in rows}, fdr)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCANNED = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"


def scan_secrets(docs, doc_id="doc_id", text="text", fdr=0.05):
    """One row per document: counts by kind, digest of the base spans, all spans as text."""
    limits = random_limits(docs, text, fdr)

    def work(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                base, spans = all_spans(value or "", limits)
                kinds = [k for _, k, _ in spans]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(4)), digest, joined(spans)))
            columns = list(zip(*rows)) if rows else [[] for _ in range(6)]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[p.split()[0] for p in SCANNED.split(", ")])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(work, SCANNED)


def redacted(text, spans, mark):
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs, text="text", fdr=0.05, mark="[SECRET]", found="has_secret"):
    """`docs` with every span replaced by `mark`, and whether there was one in a column named `found`.

    Rows, other columns and texts without a span stay as they are. If `docs` has a column of the new
    one's name, underscores are appended to the latter.
    """
    found = free_name(found, docs.columns)
    limits = random_limits(docs, text, fdr)
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(found, BooleanType())])

    def work(batches):
        for batch in batches:
            values = batch.column(place).to_pylist()
            spans = [all_spans(v or "", limits)[1] for v in values]
            new = [redacted(v, s, mark) if s else v for v, s in zip(values, spans)]
            columns = [pa.array(new, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            flags = pa.array([bool(s) for s in spans], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns, flags], names=[*batch.schema.names, found])

    return docs.mapInArrow(work, schema)
