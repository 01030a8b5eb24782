"""Operator 7: secrets, confirmed by their structure.

Three kinds are found by form alone: ``assign`` (a value given to a telling name), ``access`` (access key ids)
and ``hex`` (long hexadecimal runs). Further candidates, runs of base64 or hexadecimal characters, are decoded, and reported only
if what comes out parses:

* ``jwt``: a signed token whose header is a JSON object naming an algorithm and whose payload is a JSON object
* ``der``: a private key's encoding, in base64 or hex: a sequence whose nested lengths add up exactly and whose values stand as in
  PKCS #8 (plain or encrypted), PKCS #1, DSA's or SEC 1's form. Certificates and public keys have other forms and aren't reported.
* ``ssh``: an OpenSSH private-key container that parses to its end, or length-prefixed fields that fill the blob, the first of them a key type
* ``pem``: a private-key block whose body decodes to one of the two above

Matches of a kind don't overlap; failing ones are dropped and what they covered isn't tried again. The work is linear in the text, so a
very long one takes as much memory and time as its length says.

Defined cases: a null text counts as empty and has no spans; repeated rows are reported as often as they come; an empty table gives an empty
result; columns other than doc_id and text aren't read, so no name can clash; a null id stays null.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import documents
from barloom.llm.spans import Span, digest, joined, scan

KINDS = ("assign", "access", "hex")
ADDED = ("jwt", "der", "ssh", "pem")
#: SSH key types (fixed values)
KEY_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
MAGIC = b"openssh-key-v1\x00"

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so that asking for 24 characters at once finds the same runs as dropping shorter ones.
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
_ANY_HEX = re.compile(r"[0-9a-fA-F]+")
#: Dotted runs of base64 letters; possessive, so that a run is read once. A signed token is three of its parts.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")


def decoded(run: str) -> bytes | None:
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(blob: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the values that fill ``blob[at:end]`` exactly, nested ones included; None if their lengths don't add up."""
    tags: list[int] = []
    while at < end:
        if end - at < 2 or depth > 8:
            return None
        tag, length, at = blob[at], blob[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or end - at < n:
                return None
            length, at = int.from_bytes(blob[at : at + n], "big"), at + n
        if length > end - at:
            return None
        tags.append(tag)
        if tag & 0x20:
            inner = der_items(blob, at, at + length, depth + 1)
            if inner is None:
                return None
            tags += inner
        at += length
    return tags


def is_der(blob: bytes) -> bool:
    """Whether the blob is the encoding of a private key."""
    if len(blob) < 16 or blob[0] != 0x30 or der_items(blob, 0, len(blob)) is None:
        return False
    values = children(blob)
    forms = "".join({0x02: "i", 0x03: "b", 0x04: "o", 0x30: "s", 0xA0: "0", 0xA1: "1"}.get(tag, "?") for tag, _ in values)
    # PKCS #8: version, algorithm, key; encrypted: algorithm, data; PKCS #1 and DSA: nine or six numbers; SEC 1: version, key
    return bool(re.fullmatch(r"iso[01]*|so|i{9}s?|i{6}|io0?1?", forms)) and (forms[0] != "i" or values[0][1] in (b"\0", b"\1"))


def children(blob: bytes) -> list[tuple[int, bytes]]:
    """Tags and contents of the values in a sequence that :func:`der_items` has checked."""

    def value(at: int) -> tuple[int, int, int]:
        length, at = blob[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            length, at = int.from_bytes(blob[at : at + n], "big"), at + n
        return at, at + length, length

    at, end, _ = value(0)
    out = []
    while at < end:
        start, after, _ = value(at)
        out.append((blob[at], blob[start:after]))
        at = after
    return out


def fields_of(blob: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from ``at`` on, up to ``most`` of them, and where they end; None where one is longer than what is left."""
    fields: list[bytes] = []
    while at < len(blob) and (most is None or len(fields) < most):
        length = int.from_bytes(blob[at : at + 4], "big")
        if len(blob) - at < 4 or length > len(blob) - at - 4:
            return None
        fields.append(blob[at + 4 : at + 4 + length])
        at += 4 + length
    return fields, at


def is_ssh(blob: bytes) -> bool:
    if blob.startswith(MAGIC):
        # cipher, key derivation and its options, the number of keys, then the public keys and the private part
        head = fields_of(blob, len(MAGIC), 3)
        if head is None or len(head[0]) < 3 or len(blob) - head[1] < 4:
            return False
        keys = int.from_bytes(blob[head[1] : head[1] + 4], "big")
        rest = fields_of(blob, head[1] + 4, keys + 1) if 1 <= keys <= 64 else None
        return rest is not None and len(rest[0]) == keys + 1 and rest[1] == len(blob) and is_ssh(rest[0][0]) and len(rest[0][-1]) >= 8
    found = fields_of(blob, 0)
    return found is not None and len(found[0]) >= 2 and found[0][0] in KEY_TYPES


def is_object(part: str, key: str | None = None) -> bool:
    blob = decoded(part)
    if not blob or blob[:1] != b"{":
        return False
    try:
        value = json.loads(blob)
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and (key is None or isinstance(value.get(key), str))


def tokens(run: str, at: int) -> list[Span]:
    """Signed tokens in a dotted run: three parts in a row, each part looked at once."""
    parts, out, k = run.split("."), [], 0
    starts = [at, *(at + n for n in accumulate(len(part) + 1 for part in parts))]
    while k + 2 < len(parts):
        head = parts[k].find("eyJ")
        if head >= 0 and is_object(parts[k][head:], "alg") and is_object(parts[k + 1]):
            out.append(("jwt", starts[k] + head, starts[k + 2] + len(parts[k + 2])))
            k += 2
        k += 1
    return out


def confirmed(text: str) -> list[Span]:
    found: list[Span] = []
    if "eyJ" in text:
        for m in _DOTTED.finditer(text):
            found += tokens(m[0], m.start())
    for m in _RUN.finditer(text):
        run = m[0]
        blobs = [blob] if (blob := decoded(run)) else []
        if len(run) % 2 == 0 and _ANY_HEX.fullmatch(run):
            blobs.append(bytes.fromhex(run))
        if any(map(is_der, blobs)):
            found.append(("der", *m.span()))
        elif any(map(is_ssh, blobs)):
            found.append(("ssh", *m.span()))
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            blob = decoded("".join(m[2].split()))
            if blob and (is_der(blob) or is_ssh(blob)):
                found.append(("pem", *m.span()))
    return found


def find(text: str) -> list[Span]:
    """All spans by start, then kind."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += confirmed(text)
    order = {kind: k for k, kind in enumerate(KINDS + ADDED)}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def summary(text: str) -> tuple:
    spans = find(text)
    base = [s for s in spans if s[0] in KINDS]
    return (*(sum(s[0] == kind for s in base) for kind in KINDS), digest(base), joined(spans))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [*((f"n_{kind}", "long") for kind in KINDS), ("base_sha256", "string"), ("spans", "string")]
    return scan(documents(spark, sf_dir), summary, fields)
