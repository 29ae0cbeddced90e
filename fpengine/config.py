"""Configuration: perspectives, weights and constants.

FIXED VALUES — these must equal the values of the system we match, because results
depend on them. They are stated plainly and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES: perspectives of a flat fingerprint (name, columns, retrieval weight)
# ---------------------------------------------------------------------------
PERSPECTIVES: dict[str, dict] = {
    "as": {"cols": ["as-asn", "as-name", "as-bgp_prefix", "as-country_code"], "weight": 0.03},
    "whois": {"cols": ["whois-network-handle", "whois-network-name", "whois-organization-handle",
                       "whois-organization-name"], "weight": 0.03},
    "os": {"cols": ["os-vendor", "os-product", "os-version"], "weight": 0.10},
    "sw": {"cols": ["sw-vendors", "sw-products", "sw-versions"], "weight": 0.11},
    "hw": {"cols": ["hw-vendors", "hw-products", "hw-versions"], "weight": 0.13},
    "sd": {"cols": ["service-distribution"], "weight": 0.09},
    "body": {"cols": ["http-bodys"], "weight": 0.08},
    "htags": {"cols": ["http-tags"], "weight": 0.08},
    "hfavicons": {"cols": ["http-favicon-urls"], "weight": 0.15},
    "hpart": {"cols": ["http-tags", "http-favicon-urls"], "weight": 0.0},
    "http": {"cols": ["http-bodys", "http-tags", "http-favicon-urls"], "weight": 0.0},
    "certificate": {"cols": ["cert-subjects", "cert-issuers", "tls-versions"], "weight": 0.16},
    "dns": {"cols": ["dns-reverse"], "weight": 0.04},
    "overall": {"cols": ["as-info", "whois-info", "os-info", "sw-info", "hw-info", "service-distribution",
                         "http-part-info", "cert-info", "dns-reverse"], "weight": 0.0},
}
EXCLUDED_FROM_RETRIEVAL = ("hpart", "http", "overall")
EXCLUDED_FROM_COMPOSITE = ("hpart", "http")

# FIXED VALUES: drift sensitivities alpha per perspective; default for others 0.5
DRIFT_ALPHA = {"whois": 1.0, "as": 1.0, "dns": 0.9, "sd": 0.9, "htags": 0.8, "hfavicons": 0.8,
               "body": 0.7, "os": 0.3, "certificate": 0.3, "sw": 0.2, "hw": 0.2}
DRIFT_ALPHA_DEFAULT = 0.5

# FIXED VALUES: scalar constants
CONFIDENCE_EXPONENT = 2.0          # confidence = W_A ** 2
IMPORTANCE_THRESHOLD = 0.1         # normalised entropy below this -> important
MIN_CLUSTER_SIZE = 20              # density clustering
MIN_REPORT_GROUP = 2
PCA_DIM = 256
MAD_THRESHOLD = 3.5
MAD_FLOOR = 1e-10
UNSEEN_THRESHOLD = 0.5
UNSEEN_WEIGHTS = (0.4, 0.4, 0.2)   # path, key, local
VENDOR_CONFIDENCE_CUT = 0.65
TFIDF_VOCAB_CAPS = {"http-bodys": 200, "http-tags": 200, "http-favicon-urls": 100}
TFIDF_VOCAB_DEFAULT = 300
CHUNK_LENGTH = 500
CHUNK_OVERLAP = 50
FOLD_COUNT = 5
FOLD_BIG_N = 50000
FOLD_BIG_SIZE = 20000
SPLIT_SEED = 42

# FIXED VALUES: the 46 flat fingerprint columns, in order
FINGERPRINT_COLUMNS = [
    "ip",
    "as-asn", "as-name", "as-bgp_prefix", "as-country_code", "as-info",
    "loc-latitude", "loc-longitude", "loc-continent", "loc-country", "loc-country_code",
    "loc-province", "loc-city", "loc-postal_code", "loc-timezone", "loc-info",
    "dns-reverse",
    "whois-network-handle", "whois-network-name", "whois-organization-handle", "whois-organization-name",
    "whois-info",
    "os-vendor", "os-product", "os-version", "os-info",
    "service-distribution",
    "sw-vendors", "sw-products", "sw-versions", "sw-info",
    "hw-vendors", "hw-products", "hw-versions", "hw-info",
    "cert-fingerprints", "cert-subjects", "cert-issuers", "cert-info",
    "tls-versions",
    "http-bodys", "http-tags", "http-favicon-urls", "http-favicon-hashes", "http-part-info", "http-info",
]


def retrieval_perspectives() -> list[tuple[str, float]]:
    return [(n, p["weight"]) for n, p in PERSPECTIVES.items() if n not in EXCLUDED_FROM_RETRIEVAL]


@dataclass(frozen=True)
class VectorLayout:
    """How a flat vector is cut into perspective blocks (block i = dims [i*d, (i+1)*d))."""
    names: tuple[str, ...]
    weights: tuple[float, ...]
    block_dim: int

    @property
    def dim(self) -> int:
        return self.block_dim * len(self.names)


# The driver's `embeddings` table has 64-dim vectors; we read them as four 16-dim
# perspective blocks, using the retrieval weights of four fingerprint perspectives.
EMBEDDING_LAYOUT = VectorLayout(names=("sw", "hw", "hfavicons", "certificate"),
                                weights=(0.11, 0.13, 0.15, 0.16), block_dim=16)


@dataclass(frozen=True)
class RetrievalParams:
    top_k: int = 5
    neighbor_q: int = 1
    confidence_exponent: float = CONFIDENCE_EXPONENT
    layout: VectorLayout = field(default=EMBEDDING_LAYOUT)
