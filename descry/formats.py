"""Fixed values of the document formats: annotations, layouts, patterns, limits."""

from datetime import timedelta

# --- fixed values: type annotation per document kind --------------------------
ANNOTATIONS = {
    "bandwidth": "bandwidth-file 1.0",
    "distributor-metrics": "bridgedb-metrics 1.0",
    "bridge-extra-info": "bridge-extra-info 1.3",
    "pool-assignment": "bridge-pool-assignment 1.0",
    "bridge-server": "bridge-server-descriptor 1.2",
    "certificate": "dir-key-certificate-3 1.0",
    "consensus": "network-status-consensus-3 1.0",
    "exit-list": "tordnsel 1.0",
    "extra-info": "extra-info 1.0",
    "consensus-microdesc": "network-status-microdesc-consensus-3 1.0",
    "microdescriptor": "microdescriptor 1.0",
    "server": "server-descriptor 1.0",
    "bridge-status": "bridge-network-status 1.2",
    "transfer": "torperf 1.1",
    "vote": "network-status-vote-3 1.0",
    "proxy-stats": "snowflake-stats 1.0",
}

# --- fixed values: archive and recent path per document kind -------------------
# {Y} {M} {D} year, month, day; {ts} yyyy-MM-dd-HH-mm-ss; {date} yyyy-MM-dd;
# {ymd} yyyyMMdd; {hms} HHmmss; {d} digest, {d0} {d1} its first two characters;
# {DU} digest in upper case; {received} time of arrival; the rest are columns.
LAYOUTS = {
    "bandwidth": (
        "relay-descriptors/bandwidth/{Y}/{M}/{D}/{ts}-bandwidth-{DU}",
        "relay-descriptors/bandwidths/{ts}-bandwidth-{DU}",
    ),
    "bandwidth-import": (
        "relay-descriptors/bandwidth/{Y}/{M}/{D}/{ts}-bandwidth-{source}-{DU}",
        "relay-descriptors/bandwidths/{ts}-bandwidth-{source}-{DU}",
    ),
    "bridge-extra-info": (
        "bridge-descriptors/{Y}/{M}/extra-infos/{d0}/{d1}/{d}",
        "bridge-descriptors/extra-infos/{received}-extra-infos",
    ),
    "bridge-server": (
        "bridge-descriptors/{Y}/{M}/server-descriptors/{d0}/{d1}/{d}",
        "bridge-descriptors/server-descriptors/{received}-server-descriptors",
    ),
    "bridge-status": (
        "bridge-descriptors/{Y}/{M}/statuses/{D}/{ymd}-{hms}-{fingerprint}",
        "bridge-descriptors/statuses/{ymd}-{hms}-{fingerprint}",
    ),
    "pool-assignment": (
        "bridge-pool-assignments/{Y}/{M}/{D}/{ts}",
        "bridge-pool-assignments/{ts}",
    ),
    "distributor-metrics": (
        "bridgedb-metrics/{Y}/{M}/{D}/{ts}-bridgedb-metrics",
        "bridgedb-metrics/{ts}-bridgedb-metrics",
    ),
    "consensus": (
        "relay-descriptors/consensus/{Y}/{M}/{D}/{ts}-consensus",
        "relay-descriptors/consensuses/{ts}-consensus",
    ),
    "consensus-microdesc": (
        "relay-descriptors/microdesc/{Y}/{M}/consensus-microdesc/{D}/{ts}-consensus-microdesc",
        "relay-descriptors/microdescs/consensus-microdesc/{ts}-consensus-microdesc",
    ),
    "microdescriptor": (
        "relay-descriptors/microdesc/{Y}/{M}/micro/{d0}/{d1}/{d}",
        "relay-descriptors/microdescs/micro/{received}-micro-{Y}-{M}",
    ),
    "certificate": (
        "relay-descriptors/certs/{fingerprint}-{ts}",
        "relay-descriptors/certs/{fingerprint}-{ts}",
    ),
    "exit-list": ("exit-lists/{Y}/{M}/{D}/{ts}", "exit-lists/{ts}"),
    "extra-info": (
        "relay-descriptors/extra-info/{Y}/{M}/{d0}/{d1}/{d}",
        "relay-descriptors/extra-infos/{received}-extra-infos",
    ),
    "server": (
        "relay-descriptors/server-descriptor/{Y}/{M}/{d0}/{d1}/{d}",
        "relay-descriptors/server-descriptors/{received}-server-descriptors",
    ),
    "transfer": (
        "torperf/{Y}/{M}/{D}/{source}-{size}-{date}.tpf",
        "torperf/{source}-{size}-{date}.tpf",
    ),
    "transfer-analysis": (
        "onionperf/{Y}/{M}/{D}/{date}.{source}.onionperf.analysis.json.xz",
        "onionperf/{date}.{source}.onionperf.analysis.json.xz",
    ),
    "proxy-stats": (
        "snowflakes/{Y}/{M}/{D}/{ts}-snowflake-stats",
        "snowflakes/{ts}-snowflake-stats",
    ),
    "vote": (
        "relay-descriptors/vote/{Y}/{M}/{D}/{ts}-vote-{fingerprint}-{DU}",
        "relay-descriptors/votes/{ts}-vote-{fingerprint}-{DU}",
    ),
    "access-log": (
        "webstats/{virtual_host}/{Y}/{M}/{D}/{virtual_host}_{physical_host}_access.log_{ymd}",
        "webstats/{virtual_host}_{physical_host}_access.log_{ymd}",
    ),
}

# --- fixed values: monthly bundle name per document kind ----------------------
BUNDLES = {
    "exit-list": "exit-list",
    "transfer": "torperf",
    "transfer-analysis": "onionperf",
    "certificate": "certs",
    "microdescriptor": "microdescs",
    "consensus-microdesc": "microdescs",
    "consensus": "consensuses",
    "vote": "votes",
    "bandwidth": "bandwidths",
    "server": "server-descriptors",
    "extra-info": "extra-infos",
    "bridge-status": "bridge-statuses",
    "bridge-server": "bridge-server-descriptors",
    "bridge-extra-info": "bridge-extra-infos",
    "proxy-stats": "snowflakes",
    "pool-assignment": "bridge-pool-assignments",
    "distributor-metrics": "bridgedb-metrics",
}
UNDATED_BUNDLES = ("certs",)

# --- fixed values: access logs --------------------------------------------------
LOG_PATH_PATTERN = r"(\S*)-access.log-(\d{8})(?:\.?)([a-zA-Z0-9]+)$"
LOG_LINE_PATTERN = (
    r"^((?:\d{1,3}\.){3}\d{1,3}) (\S+) (\S+) "
    r"\[([\w/]+)([\w:]+)(\s[+\-]\d{4})\] "
    r'"([A-Z]+) ([^"]+) ([A-Z]+/\d\.\d)" '
    r"(\d{3}) (\d+|-)(.*)"
)
LOG_METHODS = ("GET", "HEAD", "POST")
KEPT_LOG_METHODS = ("GET", "HEAD")
DROPPED_LOG_STATUSES = (400, 404)

# --- fixed values: file names, headers and end lines of lists and statistics -----
TPF_NAME = r"\A(.+)-(\d+)-(\d{4}-\d{2}-\d{2})\.tpf\z"
ANALYSIS_NAME = r"\A(?:(\d{4}-\d{2}-\d{2})\.)(?:(.+)\.)?onionperf\.analysis\.json\.xz\z"
TARBALL_NAME = (
    r"\Afrom-([^-]+)-(\d{4})-(\d{2})-(\d{2})T(\d{2})(\d{2})(\d{2})Z\.tar(?:\.gz)?\z"
)
POOL_HEADER = "bridge-pool-assignment "
EXIT_LIST_LINES = r"\A(?:@type |Downloaded |ExitNode |Published |LastStatus |ExitAddress )"
PROXY_STATS_END = "snowflake-stats-end"
DISTRIBUTOR_METRICS_END = "bridgedb-metrics-end"

# --- fixed values: bridge authorities by tarball name prefix ---------------------
BRIDGE_AUTHORITIES = {
    "tonga": "4A0CCD2DDC7995083D73F5D667100C8A5831F16D",
    "bifroest": "1D8F3A91C37C5D1C4C19B1AD1D0CFBE8BF72D8E1",
    "serge": "BA44A889E64B93FAA2B114E02C2A279A8555C533",
}

# --- fixed values: lines a bridge document may keep unchanged --------------------
SERVER_KEPT_LINES = (
    r"^(?:accept |platform |(?:opt )?protocols |proto |uptime |bandwidth "
    r"|(?:opt )?hibernating |ntor-onion-key |ipv6-policy "
    r"|bridge-distribution-request )"
    r"|^(?:(?:opt )?hidden-service-dir|(?:opt )?caches-extra-info"
    r"|(?:opt )?allow-single-hop-exits|tunnelled-dir-server)$"
)
EXTRA_INFO_KEPT_LINES = (
    r"^(?:write-history |read-history |ipv6-write-history |ipv6-read-history "
    r"|geoip-start-time |geoip-client-origins |geoip-db-digest "
    r"|geoip6-db-digest |conn-bi-direct |ipv6-conn-bi-direct |bridge-|dirreq-"
    r"|cell-|entry-|exit-|hidserv-|padding-counts )"
)
CRYPTO_BLOCK_STARTS = (
    r"-----BEGIN [^\n]*|onion-key|signing-key|onion-key-crosscert"
    r"|ntor-onion-key-crosscert [^\n]*"
)

# --- fixed values: scrubbed addresses and the layout of a month's secret ----------
SECRET_BYTES = 83
SECRET_LENGTHS = (31, 50, 83)
SECRET_IPV4 = (0, 31)
SECRET_IPV6 = (31, 50)
SECRET_PORT = (50, 83)
PLAIN_IPV4 = "127.0.0.1"
PLAIN_PORT = "1"
SCRUBBED_IPV6_PREFIX = "[fd9f:2e19:3bcf::"

# --- fixed values: limits -----------------------------------------------------------
STALE_AFTER = timedelta(minutes=330)
STALE_PROXY_STATS_AFTER = timedelta(hours=48)
STALE_CACHE_AFTER = timedelta(hours=6)
STALE_ENTRIES_AFTER = timedelta(hours=1)
KEEP_RECENT = timedelta(days=3)
KEEP_ARCHIVE = timedelta(days=49)
KEEP_MISSING_KEYS = timedelta(hours=30)
DELETION_GRACE = timedelta(hours=2)
FULL_REFRESH_AFTER = timedelta(hours=23, minutes=30)
REPORTED_STATUS_AGE = timedelta(hours=3)
COMPLETE_PER_MILLE = 995
MISSING_WEIGHT_LIMIT = 0.999
EXEMPT_VOTE = "27B6B5996C426270A5C95488AA5BCEB6BCC86956"
KEYS_PER_BATCH = {"micro": (92, "-")}
DEFAULT_KEYS_PER_BATCH = (96, "+")
