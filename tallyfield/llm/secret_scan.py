"""Secrets in texts, with structural confirmation.

Patterns give the base finds. Beyond them, runs of base64 or hex digits are decoded and reported only if the bytes prove what
they are: a private key whose nested lengths fill each other exactly (DER or the OpenSSH container), a signed token whose
header names an algorithm that fits the length of its signature, or a text that itself holds a secret, up to ``DEPTH`` layers.

Spans are code points of the whole text, end exclusive. A null text is an empty one and has no spans. Rows come and go one by
one: repeated rows and repeated or null ids get their own result each, extra columns stay away, an empty table gives none.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "der", "jwt", "wrapped")  # the order of spans that start together
DEPTH = 3

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # of maximal runs, those with 24 digits
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
_ARMOR = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY)-----")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_LINES = re.compile(r"(?:[A-Za-z0-9+/]{64}\r?\n|[A-Za-z0-9+/]{76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[wy][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)(?![A-Za-z0-9_.-])")
_PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]+")
# signature bytes by algorithm; RSA signatures are as long as their key
_SIGNED = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114)} | {a + n: (128, 2048) for a in ("RS", "PS") for n in ("256", "384", "512")}


def fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, value) of DER values that fill ``data`` exactly, with lengths in their shortest form; else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 31 == 31:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 128:
            size = n & 127
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
            if n < 128 or n >> (8 * size - 8) == 0:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def _sequence(data: bytes) -> list[tuple[int, bytes]]:
    """Fields of the one sequence that ``data`` is, or none."""
    top = fields(data)
    return (fields(top[0][1]) or []) if top and len(top) == 1 and top[0][0] == 0x30 else []


_RSA, _EC, _ENCRYPTED = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def is_private_key(data: bytes) -> bool:
    """A private key of PKCS#1, DSA, SEC 1, PKCS#8 (plain or encrypted) or the OpenSSH container."""
    if data.startswith(b"openssh-key-v1\0"):
        return _openssh(data[15:])
    parts = _sequence(data)
    tags = [t for t, _ in parts]
    if len(parts) < 2:
        return False
    if tags[0] == 2 and parts[0][1] in (b"\0", b"\1"):
        whole = all(t == 2 and v for t, v in parts[: 9 if len(parts) > 6 else 6])
        if whole and (len(parts) == 9 or len(parts) == 10 and tags[9] == 0x30) and len(parts[1][1]) >= 32:
            return True  # RSA: modulus, exponents, primes
        if whole and len(parts) == 6 and len(parts[1][1]) >= 32:
            return True  # DSA
        if tags[1] == 4 and parts[0][1] == b"\1" and len(parts[1][1]) >= 16 and all(t in (0xA0, 0xA1) and fields(v) for t, v in parts[2:]):
            return len(parts) > 2
        if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 4 and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
            kind = fields(parts[1][1])
            if not kind or kind[0][0] != 6:
                return False
            if kind[0][1] in (_RSA, _EC):
                inner = _sequence(parts[2][1])
                return bool(inner) and inner[0][0] == 2 and (len(inner) in (9, 10) if kind[0][1] == _RSA else len(inner) >= 2 and inner[1][0] == 4)
            return bool(fields(parts[2][1]))
        return False
    if tags == [0x30, 4]:
        kind = fields(parts[0][1])
        return bool(kind) and kind[0][0] == 6 and kind[0][1].startswith(_ENCRYPTED) and len(parts[1][1]) >= 16
    return False


def _openssh(data: bytes) -> bool:
    """cipher, kdf, its options, a number of keys, so many public keys and the private part, filling the data."""
    at = 0

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        return data[at - n : at] if at <= len(data) else None

    head = [take() for _ in range(3)]
    if None in head or not head[0] or not head[1] or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 64 and all(take() for _ in range(keys)) and bool(take()) and at == len(data)


def _decoded(run: str) -> bytes | None:
    """Bytes of base64 in either alphabet, with or without padding."""
    digits = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(digits) % 4 == 1:
        return None
    try:
        return base64.b64decode(digits + "=" * (-len(digits) % 4), validate=True)
    except binascii.Error:
        return None


def _object(run: str) -> dict | None:
    data = _decoded(run)
    try:
        found = json.loads(data) if data and data.lstrip()[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _is_token(head: str, body: str, sign: str) -> bool:
    header = _object(head)
    low, high = _SIGNED.get(str(header.get("alg")), (1, 0)) if header else (1, 0)
    signature = _decoded(sign)
    return signature is not None and low <= len(signature) <= high and _object(body) is not None


def _armored(text: str) -> Iterator[tuple[int, int]]:
    """Spans of armored private keys whose body decodes to one; a body under the older encryption needs only whole blocks."""
    for m in _ARMOR.finditer(text):
        end = text.find("-----", m.end())
        closing = f"-----END {m.group(1)}-----"
        if end < 0 or not text.startswith(closing, end):
            continue
        body = text[m.end() : end].replace("\\r", "\n").replace("\\n", "\n")
        head, blank, rest = body.partition("\n\n")
        locked = "ENCRYPTED" in head and ":" in head and bool(blank)
        data = _decoded("".join((rest if locked else body).split()))
        if data and (len(data) >= 64 and len(data) % 8 == 0 if locked else is_private_key(data)):
            yield m.start(), end + len(closing)


def secrets(text: str, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all finds, in this order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [(a, 3, b) for a, b in _armored(text)]
    signed = [(m.start(), 5, m.end()) for m in _TOKEN.finditer(text) if _is_token(*m.groups())] if "." in text else []
    out += signed
    found = {(m.start(), m.end(), _decoded(m.group())) for m in _RUN.finditer(text)}
    found |= {(m.start(), m.end(), _decoded("".join(m.group().split()))) for m in _LINES.finditer(text)} if "\n" in text else set()
    found |= {(m.start(), m.end(), bytes.fromhex(m.group())) for m in _ANY_HEX.finditer(text) if (m.end() - m.start()) % 2 == 0}
    for start, end, data in found:
        if not data:
            continue
        if is_private_key(data):
            out.append((start, 4, end))
        elif depth and _PLAIN.fullmatch(data) and not any(a <= start and end <= b for a, _, b in signed):
            if any(kind != 2 for _, kind, _ in secrets(data.decode(), depth - 1)):
                out.append((start, 6, end))
    return sorted(set(out))


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``found``: array<struct<kind, start, stop>> by start, then kind as in ``KINDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [secrets(text.as_py() or "") for text in batch.column(len(keep))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in spans])])
            flat = [x for some in spans for x in some]
            columns = [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())]
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["kind", "start", "stop"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], [*keep, "found"])

    span = T.StructType().add("kind", "string").add("start", "long").add("stop", "long")
    schema = docs.select(*keep).schema.add("found", T.ArrayType(span))
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""

    def of(*kinds: str) -> Column:
        return F.filter("found", lambda x: x["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return find_secrets(docs, [id_col], text_col).select(F.col(id_col).alias("doc_id"), *counts, F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
