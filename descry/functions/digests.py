"""Content digests that identify documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from descry.functions.text import as_bytes, as_text, base64_unpadded

# --- fixed values: the signed part of each kind of document --------------------
SIGNED_PARTS = {
    "server": r"(?dsm)^(router .*?\nrouter-signature\n)",
    "extra-info": r"(?dsm)^(extra-info .*?\nrouter-signature\n)",
    "vote": r"(?ds)(network-status-version .*?directory-signature )",
}
WHOLE_SIGNED_PARTS = {
    "server": r"(?dsm)^(router .*?\n-----END SIGNATURE-----\n)",
    "extra-info": r"(?dsm)^(extra-info .*?\n-----END SIGNATURE-----\n)",
}


def _part(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def without_annotations(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)\A(?:@[^\n]*\n)+", "")


def descriptor_digest(raw: Column, kind: str) -> Column:
    """The digest that names a document; null when its signed part is missing.

    ``bandwidth`` hashes the bytes after annotations, ``bandwidth-import`` all.
    """
    if kind in ("microdescriptor", "bandwidth-import"):
        return F.sha2(raw, 256)
    if kind == "bandwidth":
        return F.sha2(as_bytes(without_annotations(as_text(raw))), 256)
    return F.sha1(as_bytes(_part(as_text(raw), SIGNED_PARTS[kind])))


def double_digest(text: Column, kind: str) -> Column:
    """Upper-case SHA-1 of the SHA-1 of the signed part."""
    return F.upper(F.sha1(F.unhex(F.sha1(as_bytes(_part(text, SIGNED_PARTS[kind]))))))


def double_digest_sha256(text: Column, kind: str) -> Column:
    """Base64 SHA-256 of the SHA-256 of everything up to the signature's end."""
    inner = F.sha2(as_bytes(_part(text, WHOLE_SIGNED_PARTS[kind])), 256)
    return base64_unpadded(F.unhex(F.sha2(F.unhex(inner), 256)))


def file_digest(raw: Column) -> Column:
    """Base64 SHA-256 of a whole file."""
    return F.base64(F.unhex(F.sha2(raw, 256)))


