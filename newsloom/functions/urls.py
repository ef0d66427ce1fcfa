"""URL canonicalisation and its parts."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit, urlunsplit

#: Query parameters that only track the reader.
TRACKING_PARAMS = frozenset(
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_reader utm_brand utm_social utm_social-type "
    "gclid gclsrc dclid fbclid msclkid mc_cid mc_eid igshid yclid _ga _gl ref ref_src ref_url referrer source cmpid campaign_id "
    "spm smid partner icid ito at_medium at_campaign sh share amp outputType CMP".split()
)
#: What is left of an address, safe characters of a path, index documents, default ports.
MAX_URL_LENGTH = 2048
PATH_SAFE = "/~:@!$&'()*+,;=%"
INDEX_FILES = ("index.html", "index.htm", "index.php")
DEFAULT_PORTS = {"http": 80, "https": 443}


def is_tracking(name: str) -> bool:
    """Names are compared in lower case, so the two mixed-case entries never match."""
    name = name.lower()
    return name.startswith("utm_") or name in TRACKING_PARAMS


def canonicalize_url(url: str | None, strip_query: bool = False) -> str:
    """One comparable spelling of an address; '' for none.

    Other schemes than http(s), and addresses without a host or that cannot be
    split, come back trimmed but otherwise as they are.
    """
    text = (url or "").strip()
    if not text:
        return ""
    if "://" not in text:
        text = "https://" + text.lstrip("/")
    try:
        parts = urlsplit(text)
        host = (parts.hostname or "").lower().rstrip(".").removeprefix("www.")
    except ValueError:
        return text[:MAX_URL_LENGTH]
    scheme = parts.scheme.lower() or "https"
    if scheme not in DEFAULT_PORTS or not host:
        return text[:MAX_URL_LENGTH]
    try:
        port = parts.port
    except ValueError:
        port = None
    if port is not None and port != DEFAULT_PORTS[scheme]:
        host = f"{host}:{port}"
    path = quote(unquote(parts.path), safe=PATH_SAFE).rstrip("/") or "/"
    head, _, last = path.rpartition("/")
    if last in INDEX_FILES:
        path = head or "/"
    query = ""
    if parts.query and not strip_query:
        query = urlencode(sorted(pair for pair in parse_qsl(parts.query) if not is_tracking(pair[0])), doseq=True)
    return urlunsplit((scheme, host, path, query, ""))[:MAX_URL_LENGTH]


def extract_domain(url: str | None) -> str:
    """The host in lower case without ``www.``; '' where there is none."""
    text = (url or "").strip()
    try:
        host = urlsplit(text if "://" in text else f"https://{text}").hostname or ""
    except ValueError:
        return ""
    return host.lower().rstrip(".").removeprefix("www.")
