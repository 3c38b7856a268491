"""Scalar rules for cryptographic assets: names, kinds, primitives, key lengths, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.ids import _c, unknown

# Spellings of algorithm families and the name that identifiers are looked up by.
NAME_ALIASES = {"SHA2": "SHA", "SHA-2": "SHA", "SHA3": "SHA", "SHA-3": "SHA", "3DES": "DES-EDE", "3-DES": "DES-EDE", "TRIPLEDES": "DES-EDE", "TRIPLE-DES": "DES-EDE"}
# The primitives of the bill-of-materials format (CycloneDX 1.6).
PRIMITIVES = ("ae", "block-cipher", "combiner", "drbg", "hash", "kdf", "kem", "key-agree", "mac", "pke", "signature", "stream-cipher", "xof", "other")
# The crypto functions of that format, each with its synonyms, letters only.
FUNCTION_SYNONYMS = {
    "generate": "generate",
    "keygen": "keygen keygeneration",
    "encrypt": "encrypt",
    "decrypt": "decrypt",
    "digest": "digest hash",
    "tag": "tag",
    "keyderive": "keyderive derive derivekey keyderivation",
    "sign": "sign signature",
    "verify": "verify verification keyver",
    "encapsulate": "encapsulate",
    "decapsulate": "decapsulate",
    "other": "other",
    "unknown": "unknown",
}
FUNCTIONS = {word: name for name, words in FUNCTION_SYNONYMS.items() for word in words.split()}


def _numbered(arc: str, names: str, first: int = 1, prefix: str = "") -> dict[str, str]:
    """Names that stand one after the other under an arc."""
    return {prefix + name: f"{arc}.{first + i}" for i, name in enumerate(names.split())}


# Object identifiers, by the registers they are in.
NIST = "2.16.840.1.101.3.4"  # Computer Security Objects Register
PKCS1, DIGESTS, X962, SECSIG, CURVES = "1.2.840.113549.1.1", "1.2.840.113549.2", "1.2.840.10045", "1.3.14.3.2", "1.3.101"
LMS, PBKDF2, SCRYPT, DH = "1.2.840.113549.1.9.16.3.17", "1.2.840.113549.1.5.12", "1.3.6.1.4.1.11591.4.11", "1.2.840.10046.2.1"
SM2, SM3, RC4 = "1.2.156.10197.1.501", "1.2.156.10197.1.401", "1.2.840.113549.3.4"
OIDS = {
    **{k: v for n, size in enumerate((128, 192, 256)) for k, v in _numbered(f"{NIST}.1", "ECB CBC OFB CFB WRAP GCM CCM WRAP-PAD", 20 * n + 1, f"AES-{size}-").items()},
    **_numbered(f"{NIST}.2", "SHA-256 SHA-384 SHA-512 SHA-224 SHA-512-224 SHA-512-256 SHA3-224 SHA3-256 SHA3-384 SHA3-512 SHAKE128 SHAKE256"),
    **_numbered(f"{NIST}.3", "SHA224 SHA256", 1, "DSA-"),
    **_numbered(f"{NIST}.3", "44 65 87", 17, "ML-DSA-"),
    **_numbered(f"{NIST}.3", "SHA2-128S SHA2-128F SHA2-192S SHA2-192F SHA2-256S SHA2-256F SHAKE-128S SHAKE-128F SHAKE-192S SHAKE-192F SHAKE-256S SHAKE-256F", 20, "SLH-DSA-"),
    **_numbered(f"{NIST}.4", "512 768 1024", 1, "ML-KEM-"),
    **_numbered(PKCS1, "RSA"),
    **_numbered(PKCS1, "MD5 SHA1", 4, "RSA-"),
    **_numbered(PKCS1, "RSA-OAEP", 7),
    **_numbered(PKCS1, "RSAES-OAEP", 7),
    **_numbered(PKCS1, "SHA256 SHA384 SHA512 SHA224", 11, "RSA-"),
    **_numbered(f"{X962}.2", "ECDSA"),
    **_numbered(f"{X962}.2", "ECDH"),
    **_numbered(f"{X962}.4", "ECDSA-SHA1"),
    **_numbered(f"{X962}.4.3", "SHA224 SHA256 SHA384 SHA512", 1, "ECDSA-"),
    **_numbered(DIGESTS, "MD4 MD5", 4),
    **_numbered(DIGESTS, "MD5 SHA1 SHA224 SHA256 SHA384 SHA512", 6, "HMAC-"),
    **_numbered(SECSIG, "DES-ECB DES-CBC DES-OFB DES-CFB", 6),
    **_numbered(SECSIG, "DES", 7),
    **_numbered(SECSIG, "DES-EDE SHA-0", 17),
    **_numbered(SECSIG, "3DES-EDE", 17),
    **_numbered(SECSIG, "SHA-1", 26),
    **_numbered(SECSIG, "SHA1-WITH-RSA", 29),
    **_numbered(CURVES, "X25519 X448 ED25519 ED448", 110),
    "LMS": LMS, "HSS": LMS, "HSS-LMS": LMS, "PBKDF2": PBKDF2, "SCRYPT": SCRYPT, "DH": DH, "FFDH": DH, "SM2": SM2, "SM3": SM3, "RC4": RC4,
}
# The identifier that stands for a whole family.
FAMILY_OIDS = {
    "AES": f"{NIST}.1", "SHA": f"{NIST}.2", "DSA": f"{NIST}.3", "ML-DSA": f"{NIST}.3", "MLDSA": f"{NIST}.3", "SLH-DSA": f"{NIST}.3", "SLHDSA": f"{NIST}.3", "ML-KEM": f"{NIST}.4", "MLKEM": f"{NIST}.4",
    "RSA": f"{PKCS1}.1", "RSAES-PKCS1": f"{PKCS1}.1", "RSASSA-PKCS1": PKCS1, "RSAES-OAEP": f"{PKCS1}.7", "ECDSA": f"{X962}.2.1", "ECDH": f"{X962}.2.1", "DES": f"{SECSIG}.7", "DES-EDE": f"{SECSIG}.17",
    "MD": DIGESTS, "MD4": f"{DIGESTS}.4", "MD5": f"{DIGESTS}.5", "HMAC": DIGESTS, "LMS": LMS, "PBKDF2": PBKDF2, "SCRYPT": SCRYPT, "EDDSA": CURVES, "X25519": f"{CURVES}.110", "X448": f"{CURVES}.111",
    "DH": DH, "FFDH": DH, "SM2": SM2, "SM3": SM3, "RC4": RC4,
}
# Named curves by the bits of their field (SEC 2, NIST SP 800-186, RFC 5639, X9.62).
CURVES_BY_BITS = {
    160: "secp160k1 secp160r1 secp160r2 brainpoolp160r1",
    163: "sect163k1 sect163r1 sect163r2 b-163 k-163",
    192: "secp192k1 secp192r1 prime192v1 p-192 nistp192 brainpoolp192r1",
    224: "secp224k1 secp224r1 p-224 nistp224 brainpoolp224r1",
    233: "sect233k1 sect233r1 b-233 k-233",
    239: "sect239k1",
    256: "secp256k1 secp256r1 prime256v1 p-256 nistp256 brainpoolp256r1",
    283: "sect283k1 sect283r1 b-283 k-283",
    320: "brainpoolp320r1",
    384: "secp384r1 p-384 nistp384 brainpoolp384r1",
    409: "sect409k1 sect409r1 b-409 k-409",
    512: "brainpoolp512r1",
    521: "secp521r1 p-521 nistp521",
    571: "sect571k1 sect571r1 b-571 k-571",
}
CURVE_BITS = {name: bits for bits, names in CURVES_BY_BITS.items() for name in names.split()}
#: Bytes of key material beyond which a size is taken for a mistake.
MOST_KEY_BYTES = 4096


def literal_map(values: dict[str, str | int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normal_name(name: str | Column) -> Column:
    """Trimmed, upper case, separators as single hyphens, then the alias table."""
    plain = F.regexp_replace(F.upper(F.trim(_c(name))), r"[_ -]+", "-")
    return F.coalesce(F.try_element_at(literal_map(NAME_ALIASES), plain), plain)


def algorithm_name(name: str | Column, family: str | Column, parameter_set: str | Column, mode: str | Column) -> Column:
    """The explicit name, else family[-parameter set][-MODE]."""
    built = F.concat_ws("-", unknown(family), unknown(parameter_set), F.upper(unknown(mode)))
    return F.coalesce(unknown(name), F.nullif(built, F.lit("")))


def operation_kind(text: str | Column) -> Column:
    """call with both parentheses, type_usage if identifier characters only, else expression."""
    t = F.trim(_c(text))
    return F.when(t.contains("(") & t.contains(")"), "call").when(t.rlike(r"^[A-Za-z0-9_$.]+$"), "type_usage").otherwise("expression")


def primitive(name: str | Column) -> Column:
    """The primitive's name in the format; null where unknown: such assets are skipped and counted."""
    n = F.lower(F.trim(_c(name)))
    return F.when(n.isin(*PRIMITIVES), n)


def crypto_function(name: str | Column) -> Column:
    """The function by its synonyms; other for what is not empty and not known."""
    plain = F.translate(F.lower(F.trim(_c(name))), "-_ ", "")
    return F.when(unknown(plain).isNull(), F.lit(None)).otherwise(F.coalesce(F.try_element_at(literal_map(FUNCTIONS), plain), F.lit("other")))


def object_identifier(given: str | Column, name: str | Column, built: str | Column, family: str | Column) -> Column:
    """What was given, else by name, by built name, by family; never overwritten."""
    known = literal_map(OIDS)
    by_name = [F.try_element_at(known, normal_name(x)) for x in (name, built)]
    return F.coalesce(unknown(given), *by_name, F.try_element_at(literal_map(FAMILY_OIDS), normal_name(family)))


def key_bits(derivation: str | Column, value: str | Column) -> Column:
    """Bits that an argument says, as its contract derives them; null for anything that is not a plain constant.

    ``argument_value``: a whole number of bits above 0.  ``argument_bit_length``: eight
    for each byte of a ``new byte[n]`` or of a text in double quotes, MOST_KEY_BYTES at
    most.  ``argument_curve_bits``: the field of a named curve in double quotes.
    """
    d, v = F.lower(_c(derivation)), F.trim(_c(value))
    positive = lambda n: F.when(n > 0, n)
    number = F.regexp_extract(v, r"^[+-]?\d+$", 0).try_cast("int")
    array = F.regexp_extract(v, r"^new\s+byte\s*\[\s*(\d+)\s*\]$", 1).try_cast("int")
    quoted = F.when(v.rlike(r'(?s)^".*"$') & (F.length(v) >= 2), F.substring(v, F.lit(2), F.length(v) - 2))
    size = F.coalesce(array, F.octet_length(quoted))
    return (
        F.when(d == "argument_value", positive(number))
        .when(d == "argument_bit_length", F.when(size <= MOST_KEY_BYTES, positive(size) * 8))
        .when(d == "argument_curve_bits", F.try_element_at(literal_map(CURVE_BITS), F.lower(F.trim(quoted))))
    )


def key_length(resolved: str | Column, declared: str | Column) -> Column:
    """struct<bits, declared_bits, conflict>: resolved bits first; other declared bits are kept beside."""
    r, d = _c(resolved), _c(declared)
    conflict = F.coalesce((r != d) & (d > 0), F.lit(False))
    return F.struct(F.coalesce(r, d).alias("bits"), F.when(conflict, d).alias("declared_bits"), conflict.alias("conflict"))


def live_reachability(applicable: Column, has_chain: Column, ambiguous: Column) -> Column:
    return F.when(~applicable, "not_applicable").when(has_chain, "reachable").when(ambiguous, "unknown").otherwise("unreachable")


def stitched_reachability(longest_chain: Column, suppressed_in_stitch: Column) -> Column:
    """A chain of two frames or more; else unknown if anything in the whole stitch was refused."""
    return F.when(longest_chain >= 2, "reachable").when(suppressed_in_stitch > 0, "unknown").otherwise("unreachable")


def completeness(resolved: Column, total: Column) -> Column:
    return F.when((F.coalesce(total, F.lit(0)) == 0) | (F.coalesce(resolved, F.lit(0)) == 0), "unavailable").when(resolved >= total, "complete").otherwise("partial")


def _without(entries: Column, keys: tuple[str, ...]) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(*keys))


def asset_key(kind: str | Column, metadata: str | Column, lead: dict[str, tuple[str, ...]]) -> Column:
    """kind|leading values|remaining metadata as :k=v in key order; ``lead`` names the leading keys of each kind."""
    k, m = _c(kind), _c(metadata)
    key = F.lit(None).cast("string")
    for name, fields in lead.items():
        values = F.concat_ws("|", F.lit(name), *[F.coalesce(F.try_element_at(m, F.lit(f)), F.lit("")) for f in fields])
        rest = F.array_sort(F.map_entries(_without(m, fields)))
        key = F.when(k == name, F.concat(values, F.array_join(F.transform(rest, lambda e: F.concat(F.lit(":"), e["key"], F.lit("="), e["value"])), ""))).otherwise(key)
    return key
