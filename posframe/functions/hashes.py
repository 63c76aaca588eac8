"""Digests and encodings: the built-in ones, and Arrow-batched functions for those that Spark lacks."""

from __future__ import annotations

import base64 as b64
import hashlib
import hmac as hmac_
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def md5(x: Column) -> Column:
    return F.md5(x)


def sha1(x: Column) -> Column:
    return F.sha1(x)


def sha2(x: Column, bits: int = 256) -> Column:
    return F.sha2(x, bits)


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def from_hex(x: Column) -> Column:
    return F.unhex(x)


def base64(x: Column) -> Column:
    return F.base64(x)


def unbase64(x: Column) -> Column:
    return F.unbase64(x)


def crc32(x: Column) -> Column:
    return F.crc32(x)


def _bytes(x) -> bytes | None:
    return None if x is None else x.encode() if isinstance(x, str) else bytes(x)


def _over(f, kind: str, x: Column) -> Column:
    """A function of bytes over a column, a batch at a time; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(_bytes(v)))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(x.cast("binary"))


def digest(x: Column, name: str) -> Column:
    """Any digest of the standard library, in hex: sha3_256, blake2b, blake2s..."""
    return _over(lambda v: hashlib.new(name, v).hexdigest(), "string", x)


def hmac(x: Column, key: bytes, name: str = "sha256") -> Column:
    """A keyed digest, in hex."""
    return _over(lambda v: hmac_.new(key, v, name).hexdigest(), "string", x)


def pbkdf2(x: Column, salt: bytes, rounds: int, name: str = "sha256") -> Column:
    """A key derived from a password, in hex."""
    return _over(lambda v: hashlib.pbkdf2_hmac(name, v, salt, rounds).hex(), "string", x)


def hkdf(x: Column, salt: bytes, info: bytes, length: int = 32, name: str = "sha256") -> Column:
    """A key extracted and expanded, in hex."""

    def derive(v: bytes) -> str:
        secret, block, out = hmac_.new(salt, v, name).digest(), b"", b""
        i = 1
        while len(out) < length:
            block = hmac_.new(secret, block + info + bytes([i]), name).digest()
            out, i = out + block, i + 1
        return out[:length].hex()

    return _over(derive, "string", x)


def adler32(x: Column) -> Column:
    """S15"""
    return _over(zlib.adler32, "bigint", x)


def compress(x: Column, form: str = "zlib", level: int = 6) -> Column:
    """Bytes compressed as zlib, gzip or raw deflate."""
    bits = {"zlib": 15, "gzip": 31, "deflate": -15}[form]

    def run(v: bytes) -> bytes:
        c = zlib.compressobj(level, zlib.DEFLATED, bits)
        return c.compress(v) + c.flush()

    return _over(run, "binary", x)


def decompress(x: Column, form: str = "zlib") -> Column:
    """The bytes again; bytes of another form fail the job."""
    bits = {"zlib": 15, "gzip": 31, "deflate": -15}[form]
    return _over(lambda v: zlib.decompress(v, bits), "binary", x)


def base32(x: Column) -> Column:
    return _over(lambda v: b64.b32encode(v).decode(), "string", x)
