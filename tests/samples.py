"""Documents of an invented bridge, built from named parts, and independent digests.

Nothing here was ever published: identities are hashes of words, addresses are from the
ranges set aside for documentation, the certificate is put together byte by byte.
"""

import base64
import hashlib
import ipaddress

# --- identities and secrets ----------------------------------------------------------

MONTH = "2019-11"
PUBLISHED = "2019-11-05 06:07:08"
NICKNAME = "Heron"
ADDRESS, PORT = "203.0.113.77", "9443"
ADDRESS_6, PORT_6 = "[2001:db8:0:5::c1]", "8444"


def named(what, algorithm="sha1"):
    return hashlib.new(algorithm, f"descry sample {what}".encode()).digest()


IDENTITY = named("bridge identity")
FINGERPRINT = IDENTITY.hex().upper()
HASHED_FINGERPRINT = hashlib.sha1(IDENTITY).hexdigest().upper()
AUTHORITY = named("bridge authority").hex().upper()
EXTRA_DIGEST = named("extra-info digest")
EXTRA_DIGEST_256 = named("extra-info digest", "sha256")
NTOR_KEY = base64.b64encode(named("ntor key", "sha256")).decode()
#: 31 bytes for IPv4 addresses, 19 for IPv6 addresses, 33 for ports.
SECRET = named("secret", "sha512") + named("secret", "sha1")[:19]
SECRET_HEX = SECRET.hex()


def unpadded(raw):
    return base64.b64encode(raw).decode().rstrip("=")


def grouped(digest):
    return " ".join(digest[i : i + 4] for i in range(0, len(digest), 4))


def certificate(key):
    """An identity certificate (version 1, type 4) whose one extension holds the key."""
    head = bytes([1, 4]) + (430_000).to_bytes(4, "big") + bytes([1]) + named("signing", "sha256")
    extension = (32).to_bytes(2, "big") + bytes([4, 0]) + key
    return head + bytes([1]) + extension + named("signature", "sha512")


RAW_MASTER_KEY = named("master key", "sha256")
MASTER_KEY = unpadded(RAW_MASTER_KEY)
HASHED_MASTER_KEY = unpadded(hashlib.sha256(RAW_MASTER_KEY).digest())
_encoded = base64.b64encode(certificate(RAW_MASTER_KEY)).decode()
CERTIFICATE = [_encoded[i : i + 64] for i in range(0, len(_encoded), 64)]

# --- keyed pseudonyms, computed apart from the library ---------------------------------


def scrubbed_ipv4(address, secret=SECRET, identity=IDENTITY):
    packed = ipaddress.IPv4Address(address).packed
    digest = hashlib.sha256(packed + identity + secret[:31]).digest()
    return "10." + ".".join(str(b) for b in digest[:3])


def scrubbed_ipv6(address, secret=SECRET, identity=IDENTITY):
    packed = ipaddress.IPv6Address(address.strip("[]")).packed
    digest = hashlib.sha256(packed + identity + secret[31:50]).hexdigest()
    return f"[fd9f:2e19:3bcf::{digest[58:60]}:{digest[60:64]}]"


def scrubbed_port(port, secret=SECRET, identity=IDENTITY):
    digest = hashlib.sha256(int(port).to_bytes(2, "big") + identity + secret[50:83]).digest()
    return str(0xC000 | int.from_bytes(digest[:2], "big") >> 2)


OTHER_ADDRESS = scrubbed_ipv4(ADDRESS)
OTHER_PORT = scrubbed_port(PORT)
OTHER_ADDRESS_6 = f"{scrubbed_ipv6(ADDRESS_6)}:{scrubbed_port(PORT_6)}"

# --- documents ----------------------------------------------------------------------


def block(kind, *content):
    return [f"-----BEGIN {kind}-----", *content, f"-----END {kind}-----"]


SIGNED = [
    "router-sig-ed25519 " + unpadded(named("router signature", "sha512")),
    "router-signature",
    *block("SIGNATURE", base64.b64encode(named("rsa signature", "sha512")).decode()),
]
IDENTITY_BLOCK = ["identity-ed25519", *block("ED25519 CERT", *CERTIFICATE)]

SERVER_LINES = [
    f"router {NICKNAME} {ADDRESS} {PORT} 0 0",
    *IDENTITY_BLOCK,
    f"master-key-ed25519 {MASTER_KEY}",
    "bandwidth 5242880 10485760 3145728",
    "platform Tor 0.4.2.1 on FreeBSD",
    f"published {PUBLISHED}",
    f"fingerprint {grouped(FINGERPRINT)}",
    "uptime 86417",
    f"extra-info-digest {EXTRA_DIGEST.hex().upper()} {unpadded(EXTRA_DIGEST_256)}",
    "caches-extra-info",
    "onion-key",
    *block("RSA PUBLIC KEY", base64.b64encode(named("onion key", "sha256")).decode()),
    f"ntor-onion-key {NTOR_KEY}",
    "contact heron-keeper <keeper@heron.example>",
    f"reject {ADDRESS}:*",
    "reject *:*",
    *SIGNED,
]
EXTRA_INFO_LINES = [
    f"extra-info {NICKNAME} {FINGERPRINT}",
    *IDENTITY_BLOCK,
    f"published {PUBLISHED}",
    "read-history 2019-11-05 03:00:00 (86400 s) 7340032,1048576",
    "transport-info version=3",
    f"transport obfs4 {ADDRESS}:10443 cert=heron,iat-mode=0",
    "bridge-ips nz=16,is=8",
    *SIGNED,
]
ENTRY = (
    f"r {NICKNAME} {unpadded(IDENTITY)} {unpadded(named('descriptor'))} "
    f"{PUBLISHED} {ADDRESS} {PORT} 0"
)
STATUS_LINES = [
    "published 2019-11-05 09:10:11",
    "flag-thresholds stable-uptime=432100 fast-speed=20480",
    ENTRY,
    f"a {ADDRESS_6}:{PORT_6}",
    "s Running Stable Valid",
    "w Bandwidth=301",
]
HASHED_R = " ".join(
    [
        f"r {NICKNAME}",
        unpadded(hashlib.sha1(IDENTITY).digest()),
        unpadded(hashlib.sha1(named("descriptor")).digest()),
        PUBLISHED,
    ]
)


def text(lines):
    return "\n".join(lines) + "\n"


def edited(lines, start, *replacement):
    """Lines with those starting with ``start`` replaced."""
    out = []
    for line in lines:
        out.extend(replacement if line.startswith(start) else [line])
    return out


def signed_part(document, start, end="\nrouter-signature\n"):
    a = document.index(start)
    return document[a : document.index(end, a) + len(end)].encode("latin-1")


def double_sha1(document, start):
    inner = hashlib.sha1(signed_part(document, start)).digest()
    return hashlib.sha1(inner).hexdigest()


def double_sha256(document, start):
    part = signed_part(document, start, "\n-----END SIGNATURE-----\n")
    return unpadded(hashlib.sha256(hashlib.sha256(part).digest()).digest())
