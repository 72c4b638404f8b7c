"""Text, digest, encryption and time expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results must equal these patterns and lists.
SOCIAL_SECURITY = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\b(?:\+?(\d{1,3}))?[-. (]*(\d{3})[-. )]*(\d{3})[-. ]*(\d{4})\b"
REDACTION = "[REDACTED]"
BASE64_TEXT = r"^[A-Za-z0-9+/]+={0,2}\n?\z"
HEX_TEXT = r"^[0-9a-fA-F]+\n?\z"
ESCAPED_UNICODE = r"\\u[0-9a-fA-F]{4}"
RANSOMWARE_FILE = r"\.(locky|zepto|xyz|crypt)$"

# Our definitions where only a name is given.
RANSOM_NOTE_WORDS = r"(?i)readme|decrypt|recover|restore|ransom|how_to"
ENCRYPTED_ENTROPY = 7.2


def redact_pii(text: Column) -> Column:
    """Social-security, then phone numbers replaced by a marker."""
    return F.regexp_replace(F.regexp_replace(text, SOCIAL_SECURITY, REDACTION), PHONE, REDACTION)


def encoding_flags(text: Column) -> Column:
    """Struct of base64, hex, unicode: how the whole text seems to be encoded."""
    return F.struct(
        text.rlike(BASE64_TEXT).alias("base64"),
        text.rlike(HEX_TEXT).alias("hex"),
        text.rlike(ESCAPED_UNICODE).alias("unicode"),
    )


def sanitize_input(text: Column) -> Column:
    """Comment marks dropped, then everything but letters, digits, ``_`` and ``-``."""
    return F.regexp_replace(F.regexp_replace(text, "--", ""), "[^A-Za-z0-9_-]", "")


def _entropy_of(content: str | bytes | None) -> float | None:
    if content is None or len(content) == 0:
        return None
    raw = content.encode("utf-8") if isinstance(content, str) else bytes(content)
    shares = np.bincount(np.frombuffer(raw, dtype=np.uint8)) / len(raw)
    return float(-np.sum(shares * np.log2(shares + 1e-9)))


@F.pandas_udf(T.DoubleType())
def byte_entropy(content: pd.Series) -> pd.Series:
    """``-sum p*log2(p + 1e-9)`` over the bytes of a text or binary of any length.

    Arrow batches keep it a single narrow stage; exploding bytes would shuffle every one of them.
    """
    return pd.Series([_entropy_of(c) for c in content], dtype="float64")


def note_keyword_count(files: Column) -> Column:
    """Ransom-note words in the names of created files."""
    return F.regexp_count(F.array_join(files, " "), F.lit(RANSOM_NOTE_WORDS)).cast("int")


def looks_encrypted(entropy: Column, files: Column) -> Column:
    """Very high entropy together with a ransomware extension on a created file."""
    return (entropy > ENCRYPTED_ENTROPY) & F.exists(files, lambda f: f.rlike(RANSOMWARE_FILE))


def mail_authentication(header: Column) -> Column:
    """Struct of dmarc, dkim, spf results and whether all passed, from an Authentication-Results header."""
    result = lambda name: F.lower(F.regexp_extract(header, rf"(?i)\b{name}=([a-z]+)", 1))
    checks = {name: result(name) for name in ("dmarc", "dkim", "spf")}
    passed = (checks["dmarc"] == "pass") & (checks["dkim"] == "pass") & (checks["spf"] == "pass")
    return F.struct(*[c.alias(n) for n, c in checks.items()], F.coalesce(passed, F.lit(False)).alias("authenticated"))


def iso_timestamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def age_in_days(created: Column, reference: Column) -> Column:
    """Whole elapsed days, rounded down, as a timedelta counts them."""
    seconds = F.unix_micros(reference.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    return F.floor(seconds / F.lit(86_400_000_000)).cast("int")


def encrypt_text(text: Column, key: Column) -> Column:
    """AES-GCM as base64 on one line; the random nonce makes every result different."""
    return F.translate(F.base64(F.aes_encrypt(text, key, F.lit("GCM"))), "\r\n", "")


def decrypt_text(cipher: Column, key: Column) -> Column:
    """Inverse of ``encrypt_text``; NULL when the cipher text was tampered with."""
    return F.try_aes_decrypt(F.try_to_binary(cipher, F.lit("base64")), key, F.lit("GCM")).cast("string")


def encrypt_fields(df: DataFrame, fields: Sequence[str], key: Column) -> DataFrame:
    """Encrypt those configured columns that are present."""
    present = [f for f in fields if f in df.columns]
    return df.withColumns({f: encrypt_text(F.col(f).cast("string"), key) for f in present})


def decrypt_fields(df: DataFrame, fields: Sequence[str], key: Column) -> DataFrame:
    present = [f for f in fields if f in df.columns]
    return df.withColumns({f: decrypt_text(F.col(f), key) for f in present})
