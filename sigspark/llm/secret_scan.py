"""Secret scans: key patterns and a token-efficiency test.

Random strings take many tokens for their length, because a vocabulary learned from prose
has no long pieces of them. Runs of key characters with few characters per token are
reported, after digests of known lengths and identifiers are set aside.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import groups, light_batches, pick, table, utf8_view

#: Kinds in the order in which they are listed; "random" is the token-efficiency test's.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A greedy run of 24 or more is the maximal run, as with [0-9a-f]+ and a test of its length.
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Lengths of hexadecimal digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Numbers, dates and numbering; each expression reads a run in one way only, so that none backtracks.
_IDENTIFIER = re.compile(r"[0-9_/+=-]+|[A-Za-z]?[0-9](?:[0-9]|[A-Za-z][0-9]|[-_/][A-Za-z]?[0-9])*[-_/]?")
_LETTERS = re.compile(r"[A-Za-z_/+=-]*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Characters per token below which a run counts as random.
CHARS_PER_TOKEN = 2.0
#: Characters of a run that are encoded at once: the encoder's time grows faster than a piece's length.
PIECE = 4096


def rank_path() -> str:
    """The default rank file (tiktoken)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the key patterns, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def is_name(run: str, encoding) -> bool:
    """True for letters and signs, with up to four digits at the end, whose camel and snake parts are
    single tokens of three letters on average."""
    body = run.rstrip("=")
    head = body.rstrip("0123456789")
    if len(body) - len(head) > 4 or not _LETTERS.fullmatch(head):
        return False
    parts = _PART.findall(run)
    return bool(parts) and sum(map(len, parts)) >= 3 * len(parts) and all(len(encoding.encode_ordinary(p)) == 1 for p in parts)


def is_random(run: str, encoding, chars_per_token: float = CHARS_PER_TOKEN) -> bool:
    """True for a run that takes too many tokens and is no digest, UUID, number or name."""
    if _DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or _UUID.fullmatch(run) or _IDENTIFIER.fullmatch(run):
        return False
    if len(set(run)) < 8:
        return False
    tokens = sum(len(encoding.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))
    return len(run) < chars_per_token * tokens and not is_name(run, encoding)


def all_spans(text: str, encoding, chars_per_token: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """base_spans with the random runs that overlap none of them."""
    base = base_spans(text)
    found, at = list(base), 0
    ends = []
    for start, _, end in base:
        ends.append(max(end, ends[-1] if ends else 0))
    for m in _RUN.finditer(text):
        while at < len(base) and ends[at] <= m.start():
            at += 1
        if at < len(base) and base[at][0] < m.end():  # it ends behind the run's start, as none before it does
            continue
        if is_random(m[0], encoding, chars_per_token):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def spell(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of each span, comma-joined; code points, end exclusive."""
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by [REDACTED]."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], "[REDACTED]"]
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), *, path: str | None = None, chars_per_token: float = CHARS_PER_TOKEN, redacted: bool = False) -> DataFrame:
    """Secrets of every whole text, one row per row of docs.

    Returns the carried columns, n_assign, n_access, n_hex, n_random, base_sha256 and
    spans; with redacted also the text without them (null stays null). A null text counts as
    empty: no spans and the digest of the empty string. Keys may be null or repeat.
    """
    path = path or rank_path()
    light_batches(docs.sparkSession)
    source = pick(docs, **{f"k{i}": c for i, c in enumerate(carry)}, text=text)
    n = len(carry)
    fields = "".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}, " for i in range(n))
    schema = fields + "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string" + ", redacted string" * redacted

    def run(batches):
        encoding = _encoding(path)
        for batch in (b.slice(i, j - i) for b in batches for i, j in groups(utf8_view(b.column(n))[0])):
            counts: list[list[int]] = [[], [], [], []]
            digests, spelled, clean = [], [], []
            for value in batch.column(n):
                whole = value.as_py()
                spans = all_spans(whole, encoding, chars_per_token) if whole else []
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(spell([s for s in spans if s[1] < 3]).encode()).hexdigest())
                spelled.append(spell(spans))
                if redacted:
                    clean.append(redact(whole, spans) if spans else whole)
            arrays = [*batch.columns[:n], *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spelled, pa.string())]
            names = [*[f"k{i}" for i in range(n)], "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
            if redacted:
                arrays.append(pa.array(clean, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(arrays, names)

    got = source.mapInArrow(run, schema)
    return got.toDF(*carry, *got.columns[n:])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    return scan(table(spark, sf_dir, "documents"))
