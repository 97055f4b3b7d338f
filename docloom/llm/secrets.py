"""Secret scans with structural confirmation.

Pattern matches (assignments, access ids, long hex) are reported as they are.
Base64 and hex runs, PEM blocks and dotted tokens are decoded first and
reported only where the bytes parse: as DER with exactly nested lengths in the
shape of a private key, as an OpenSSH key with exactly nested strings, or as a
signed token with a JSON header that names its algorithm. Base64 may be wrapped
over lines. An encrypted PEM key can't be parsed inside; its headers must name
a cipher and an initial vector, and its bytes must be whole blocks that aren't
plain text. Random runs, public keys and certificates don't parse so and are
left alone. Bare keys are looked for up to ``KEY_BYTES``, token headers up to
``HEADER_CHARS``.

Scanning is a narrow step over whole texts: no shuffle, no state. Its time is
linear in a text's length: PEM marks are paired in one walk, and what follows
from a candidate's start is bounded by the two constants.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docloom.llm.arrow import add_columns

#: In the order in which kinds that start together are listed.
KINDS = ("assign", "access", "hex", "key", "token")

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
NEXT_LINE = re.compile(r"(?:\r\n|\n|\r|\\n)[\x20\t]*([A-Za-z0-9+/_-]+={0,2})")
ANYHEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?([0-9A-Fa-f]{64,})(?![0-9A-Za-z])")
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
#: Where a token's header may begin: at a boundary, with what base64 makes of a brace and a quote or blank.
HEADER = re.compile(r"(?:^|(?<=[-_]))e(?:yJ|yA|wo|w0|wk)")
KEY_BYTES, HEADER_CHARS = 1 << 14, 4096
OPENSSH = base64.b64encode(b"openssh-key-v1").decode()[:18]

#: For each pattern, one that RE2 searches whole batches for; only rows that it finds are scanned in Python.
SIEVES = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]",
    "access": r"AKIA[A-Z0-9]",
    "hex": r"[0-9a-f]{32}",
    "run": r"[A-Za-z0-9+/_-]{40}|-----BEGIN [A-Z0-9 ]*PRIVATE KEY|e(?:yJ|yA|wo|w0|wk)[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.",
}

Span = tuple[str, int, int]


def _der(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, value) items that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size, at = int.from_bytes(data[at : at + more]), at + more
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def der_private_key(data: bytes) -> bool:
    """PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8, with nothing left over."""
    outer = _der(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    items = _der(outer[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    if tags[0] == 0x02:
        if items[0][1] not in (b"\x00", b"\x01"):
            return False
        if all(t == 0x02 for t in tags) and len(tags) in (6, 9):
            return True
        if tags[:2] == [0x02, 0x04] and items[0][1] == b"\x01" and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return len(items[1][1]) >= 16
        tags, items = tags[1:], items[1:]
    if tags[:2] != [0x30, 0x04] or any(t not in (0xA0, 0xA1, 0x81) for t in tags[2:]):
        return False
    algorithm = _der(items[0][1])
    return bool(algorithm) and algorithm[0][0] == 0x06 and len(items[1][1]) >= 16


def openssh_private_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(string() is None for _ in range(3)):
        return False
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    if not 1 <= keys <= 16 or any(string() is None for _ in range(keys)):
        return False
    return bool(string()) and not data[at:].strip(b"\0")


def private_key(data: bytes) -> bool:
    return der_private_key(data) or openssh_private_key(data)


def decode64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    data = decode64(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(header: str, payload: str, signature: str) -> bool:
    """A header that names its algorithm, a claims object, and a signature."""
    head = _object(header)
    if head is None or not isinstance(head.get("alg"), str):
        return False
    if _object(payload) is None:
        return False
    return len(decode64(signature) or b"") >= 16 or (head["alg"].lower() == "none" and not signature)


def base_spans(text: str, want: tuple[str, ...] = ("assign", "access", "hex")) -> list[Span]:
    out: list[Span] = []
    if "assign" in want:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "access" in want:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if "hex" in want:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def pem_key(body: str) -> bool:
    """Whether the lines between PEM marks hold a private key, in the open or encrypted."""
    lines = re.split(r"[\r\n]+|\\n", body)
    data = decode64(re.sub(r"\s+", "", "".join(x for x in lines if ":" not in x)))
    if not data:
        return False
    if private_key(data):
        return True
    headers = dict(x.strip().split(":", 1) for x in lines if ":" in x)
    iv = re.fullmatch(r"\s*[A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s*", headers.get("DEK-Info", ""))
    if not iv or headers.get("Proc-Type", "").replace(" ", "") != "4,ENCRYPTED":
        return False
    return len(data) >= 48 and len(data) % (len(iv[1]) // 2) == 0 and not data.isascii()


def pem_spans(text: str) -> list[Span]:
    """Key blocks from a BEGIN mark to the END mark of its label, if no other mark stands between them."""
    out, begun = [], None
    for m in PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begun = m
            continue
        if begun and begun[2] == m[2] and pem_key(text[begun.end() : m.start()]):
            out.append(("key", begun.start(), m.end()))
        begun = None
    return out


def _wrapped_end(text: str, m: re.Match) -> int | None:
    """Where the key ends that begins with the run ``m`` and goes on in the next lines, or None."""
    if m[0][0] == "M":
        head = decode64(m[0][:8]) or b""
        more = head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0
        if head[:1] != b"\x30" or not 1 <= more <= 3:
            return None
        size = 2 + more + int.from_bytes(head[2 : 2 + more])
        need = -(-size * 4 // 3) if size <= KEY_BYTES else 0
    else:
        need = KEY_BYTES * 4 // 3 if m[0].startswith(OPENSSH) else 0
    parts, got, end = [m[0]], len(m[0]), m.end()
    while got < need and (line := NEXT_LINE.match(text, end)) and not line[1].startswith(OPENSSH):
        parts.append(line[1])
        got, end = got + len(line[1]), line.end()
        if len(line[1]) < len(m[0]):
            break
    data = decode64("".join(parts)) if len(parts) > 1 else None
    return end if data and private_key(data) else None


def token_spans(text: str) -> list[Span]:
    """Three dotted parts that parse as a signed token; its header may follow a dot, dash or underscore."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            a, b, c = parts[i : i + 3]
            found = None
            for h in HEADER.finditer(a, max(0, len(a) - HEADER_CHARS)):
                if signed_token(a[h.start() :], b, c):
                    found = h.start()
                    break
            used = 1
            if found is not None:
                out.append(("token", at + found, at + len(a) + len(b) + len(c) + 2))
                used = 3
            at += sum(len(p) + 1 for p in parts[i : i + used])
            i += used
    return out


def confirmed_spans(text: str) -> list[Span]:
    out = pem_spans(text)
    inside, k, done = list(out), 0, 0
    for m in BASE64.finditer(text):
        while k < len(inside) and inside[k][2] <= m.start():
            k += 1
        if m.start() < done or (k < len(inside) and inside[k][1] <= m.start()):
            continue
        data = decode64(m[0])
        end = m.end() if data and private_key(data) else _wrapped_end(text, m)
        if end:
            out.append(("key", m.start(), end))
            done = end
    for m in ANYHEX.finditer(text):
        if not len(m[1]) % 2 and private_key(bytes.fromhex(m[1])):
            out.append(("key", m.start(1), m.end()))
    return out + token_spans(text)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_texts(texts: list[str | None]) -> list[list[Span]]:
    """Ordered spans of each text; null counts as empty."""
    column = pa.array(["" if t is None else t for t in texts], pa.string())
    hits = {k: pc.match_substring_regex(column, p).to_pylist() for k, p in SIEVES.items()}
    out = []
    for i, t in enumerate(texts):
        want = tuple(k for k in ("assign", "access", "hex") if hits[k][i])
        spans = base_spans(t, want) if want else []
        out.append(in_order(spans + (confirmed_spans(t) if hits["run"][i] else [])) if spans or hits["run"][i] else [])
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
PA_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets``: ordered (kind, start, end), code points, end exclusive.

    Every row is kept. Null and empty texts have no spans. Kinds may overlap;
    within one kind they don't. A column named ``secrets`` is replaced.
    """

    def scan(texts: list) -> list[list]:
        return [[[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in scan_texts(texts)]]

    return add_columns(docs, [text], {"secrets": (SPANS, PA_SPANS)}, scan)


def redact_text(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` in place of every span of :func:`scan_secrets`.

    Overlapping spans become one mark. All rows and columns stay; texts without
    spans, and nulls, are unchanged.
    """
    kind = dict(docs.dtypes)

    def redact(texts: list) -> list[list]:
        return [[redact_text(t, s, mark) if s else t for t, s in zip(texts, scan_texts(texts), strict=True)]]

    assert kind[text] == "string", f"{text} is not a string column"
    return add_columns(docs, [text], {text: (T.StringType(), pa.string())}, redact).select(*docs.columns)


def digest_row(spans: list[Span]) -> tuple:
    base = [s for s in spans if s[0] in KINDS[:3]]
    count = [sum(s[0] == k for s in base) for k in KINDS[:3]]
    return (*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and all spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(found: list) -> list[list]:
        rows = [digest_row([(s["kind"], s["start"], s["end"]) for s in spans]) for spans in found]
        return [list(c) for c in zip(*rows, strict=True)] or [[]] * 5

    long, string = (T.LongType(), pa.int64()), (T.StringType(), pa.string())
    added = {"n_assign": long, "n_access": long, "n_hex": long, "base_sha256": string, "spans": string}
    return add_columns(scan_secrets(docs).select("doc_id", "secrets"), ["secrets"], added, digest).drop("secrets")
