"""Links: one form per page, and what kind of page it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import once

# fixed values
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|ref_src)$"
ARXIV_PATH = r"(?i)^/(?:abs|pdf|html)/(\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?/?$"
RESERVED_OWNERS = ["orgs", "topics", "features", "settings", "marketplace", "sponsors", "about", "search", "explore"]
YOUTUBE_HOSTS, YOUTUBE_PATH, YOUTUBE_ID = ["youtube.com", "youtube-nocookie.com"], r"^/(?:shorts|embed|live)/([\w-]+)", r"^[A-Za-z0-9_-]{11}$"
VIMEO_HOST, VIMEO_PATH = r"(^|\.)player\.vimeo\.com$", r"^/video/(\d+)"
X_HOSTS, X_PATH = ["x.com", "twitter.com"], r"^/[^/]+/status/(\d+)"
PARTS = r"(?i)^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, i)


def host(url: Column) -> Column:
    """Host in lower case, without user, port and dots at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^.*@", ""), r"\.*(:\d*)?$", "")


def host_of(url: Column) -> Column:
    """Host without www., null if the text is no link."""
    return F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def _number(part: Column) -> Column:
    """Value of one part of an address: decimal, 0x.. or 0.. (octal); null if it is no such number."""
    hexed, octal = F.regexp_extract(part, r"^0x([0-9a-f]{0,12})$", 1), F.regexp_extract(part, r"^0([0-7]{1,16})$", 1)
    return (
        F.when(part.rlike(r"^0x[0-9a-f]{0,12}$"), F.conv(F.concat(F.lit("0"), hexed), 16, 10))
        .when(part.rlike(r"^0[0-7]{1,16}$"), F.conv(octal, 8, 10))
        .when(part.rlike(r"^(0|[1-9]\d{0,12})$"), part)
        .cast("long")
    )


def is_numeric(name: Column) -> Column:
    """Whether a host's last part is a number, which makes the whole an IPv4 address, well spelt or not."""
    return F.element_at(F.split(name, r"\."), -1).rlike(r"^(\d+|0x[0-9a-f]*)$")


def ipv4(name: Column) -> Column:
    """An IPv4 address as a number, in any spelling (one to four parts, the last one fills the rest); null if it is none."""

    def whole(parts: Column) -> Column:
        n = F.size(parts)
        last, front = F.element_at(parts, -1), F.slice(parts, F.lit(1), n - 1)
        head = F.aggregate(front, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        left = F.element_at(F.array(*(F.lit(256 ** (4 - k)) for k in range(4))), F.least(n, F.lit(4)))  # values that the last part has
        good = (n <= 4) & ~F.exists(parts, lambda x: x.isNull()) & ~F.exists(front, lambda x: x > 255) & (last < left)
        return F.when(F.coalesce(good, F.lit(False)), head * left + last)

    return once(F.transform(F.split(name, r"\."), _number), whole)


def _private(whole: Column) -> Column:
    a, b = F.floor(whole / (1 << 24)), F.floor(whole / (1 << 16)) % 256
    return a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))


def is_private_v4(name: Column) -> Column:
    """Loopback, private, link-local, carrier, multicast and reserved addresses, in any spelling."""
    return F.coalesce(once(ipv4(name), _private), F.lit(False))


def ipv6(text: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address, with or without brackets; null if it is none. Its last 32 bits may be written as an IPv4 address."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^\[|\]$", "")
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    quad = [F.regexp_extract(bare, rf"^(.*:){byte}\.{byte}\.{byte}\.{byte}$", i) for i in range(1, 6)]
    two = lambda a, b: F.lower(F.hex(F.nullif(a, F.lit("")).cast("int") * 256 + F.nullif(b, F.lit("")).cast("int")))
    plain = F.when(quad[0] != "", F.concat(quad[0], two(quad[1], quad[2]), F.lit(":"), two(quad[3], quad[4]))).otherwise(bare)

    def groups(sides: Column) -> Column:
        pieces = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
        head, tail = pieces(F.get(sides, F.lit(0))), pieces(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        left = 8 - F.size(head) - F.size(tail)
        good = F.forall(F.concat(head, tail), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(F.size(sides) == 2, left >= 1).otherwise((F.size(sides) == 1) & (left == 0))
        filled = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(left, F.lit(0))), tail)
        return F.when(F.coalesce(good, F.lit(False)), F.transform(filled, lambda g: F.conv(g, 16, 10).cast("int")))

    return once(F.split(plain, "::"), groups)


def carried_v4(groups: Column) -> Column:
    """The IPv4 address that an IPv6 one carries, as a number: compatible, mapped, NAT64 (the last 32 bits) or 6to4 (after the first group); else null."""
    at = lambda i: F.get(groups, F.lit(i)).cast("long")
    front = F.slice(groups, 1, 6)
    carries = reduce(Column.__or__, (front == F.array(*map(F.lit, p)) for p in ((0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0xFFFF), (0x64, 0xFF9B, 0, 0, 0, 0))))
    return F.when(at(0) == 0x2002, at(1) * 65536 + at(2)).when(carries, at(6) * 65536 + at(7))


def is_private(address: Column) -> Column:
    """Whether an address, IPv4 or IPv6, is loopback, private, link-local, carrier-grade, multicast or reserved, or carries such an IPv4 one."""
    bare = F.regexp_replace(F.lower(F.trim(address)), r"^\[|\]$", "")
    inner = once(ipv6(address), carried_v4)
    by_name = bare.rlike("^(f[cd]|fe[89ab]|ff)")
    v4 = F.when(bare.rlike(r"^\d+\.\d+\.\d+\.\d+$"), ipv4(bare))
    return F.coalesce(once(F.coalesce(v4, inner), lambda n: F.when(n.isNotNull(), _private(n))), by_name, F.lit(False))


def is_submittable(url: Column) -> Column:
    """http(s) to a public, dotted name or a public IPv4 address; every IPv6 literal is refused."""

    def public(name: Column) -> Column:
        plain = (name != "") & (name != "localhost") & ~name.rlike(r"\.(local|internal|localhost)$") & name.contains(".") & ~name.startswith("[")
        address = once(ipv4(name), lambda whole: whole.isNotNull() & ~F.coalesce(_private(whole), F.lit(False)))
        return F.when(is_numeric(name), address).otherwise(plain)

    return F.coalesce(once(host(url), public), F.lit(False))


def safe_href(raw: Column, base: Column) -> Column:
    """A link for a page of address ``base``: http(s) alone, relative ones resolved; null for every other scheme and for blanks."""
    link = F.trim(raw)
    root, path = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"(?i)^https?://[^/?#]+([^?#]*/)?", 1)
    found = (
        F.when(link.rlike(r"(?i)^https?://[^/?#\s]"), link)
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (link == "") | (root == ""), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.regexp_extract(root, r"(?i)^(https?:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#") | link.startswith("?"), F.concat(F.regexp_extract(base, rf"^([^{'#'}?]*)", 1), link))
        .otherwise(F.concat(root, F.when(path == "", "/").otherwise(path), F.regexp_replace(link, r"^(\./)+", "")))
    )
    return found


def param(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(_part(url, 4), rf"(?:^|&){name}=([^&]*)", 1), F.lit(""))


def youtube_id(url: Column) -> Column:
    name, path = F.regexp_replace(host(url), r"^(www|m|music)\.", ""), _part(url, 3)
    found = F.when(name == "youtu.be", F.regexp_extract(path, r"^/([^/]*)", 1)).when(
        name.isin(YOUTUBE_HOSTS), F.coalesce(param(url, "v"), F.regexp_extract(path, YOUTUBE_PATH, 1))
    )
    return F.when(found.rlike(YOUTUBE_ID) & (found != "videoseries"), found)


def video_of(url: Column) -> Column:
    """struct(provider, video_id) of the single video that a link plays; null for lists and other links."""
    tube = youtube_id(url)
    vimeo = F.when(host(url).rlike(VIMEO_HOST), F.nullif(F.regexp_extract(_part(url, 3), VIMEO_PATH, 1), F.lit("")))
    found = F.coalesce(tube, vimeo)
    return F.when(found.isNotNull(), F.struct(F.when(tube.isNotNull(), "youtube").otherwise("vimeo").alias("provider"), found.alias("video_id")))


def arxiv_id(url: Column) -> Column:
    return F.when(host(url).rlike(r"(^|\.)arxiv\.org$"), F.nullif(F.regexp_extract(_part(url, 3), ARXIV_PATH, 1), F.lit("")))


def github_repo(url: Column) -> Column:
    """owner/repo of a repository's own pages."""
    bits = F.filter(F.split(_part(url, 3), "/"), lambda x: x != "")
    owner, repo, section = (F.get(bits, F.lit(i)) for i in range(3))
    good = host(url).isin("github.com", "www.github.com") & owner.isNotNull() & repo.isNotNull() & ~owner.isin(RESERVED_OWNERS) & (section.isNull() | (section == "tree"))
    return F.when(good, F.concat_ws("/", owner, F.regexp_replace(repo, r"\.git$", "")))


def x_status_id(url: Column) -> Column:
    name = F.regexp_replace(host(url), r"^(www|mobile)\.", "")
    return F.when(name.isin(X_HOSTS), F.nullif(F.regexp_extract(_part(url, 3), X_PATH, 1), F.lit("")))


def detect_source(url: Column) -> Column:
    return (
        F.when(youtube_id(url).isNotNull(), "youtube")
        .when(arxiv_id(url).isNotNull(), "arxiv")
        .when(github_repo(url).isNotNull(), "github")
        .when(x_status_id(url).isNotNull(), "x")
        .when(F.lower(_part(url, 3)).endswith(".pdf"), "pdf")
        .otherwise("article")
    )


def url_key(url: Column) -> Column:
    """The one form of a page's link; text that is no public link stays as it is."""
    name = F.regexp_replace(host(url), r"^www\.", "")
    port = F.regexp_extract(_part(url, 2), r"(:\d+)$", 1)
    scheme = F.lower(_part(url, 1))
    port = F.when(((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), F.lit("")).otherwise(port)
    on_x = x_status_id(url).isNotNull()
    kept = F.filter(
        F.split(_part(url, 4), "&"),
        lambda q: (q != "") & ~F.regexp_extract(q, r"^([^=]*)", 1).rlike(TRACKING) & ~(on_x & F.regexp_extract(q, r"^([^=]*)", 1).isin("s", "t")),
    )
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    path = F.when(F.length(_part(url, 3)) > 1, F.regexp_replace(_part(url, 3), r"/+$", "")).otherwise(_part(url, 3))
    path = F.when(path == "", "/").otherwise(path)
    plain = F.concat(scheme, F.lit("://"), name, port, path, query)
    paper = F.concat(F.lit("https://"), name, F.lit("/abs/"), arxiv_id(url))
    return F.when(is_submittable(url), F.coalesce(paper, plain)).otherwise(url)


def parse_id(text: Column) -> Column:
    return F.when(text.rlike(r"^[1-9]\d{0,15}$"), text.try_cast("bigint"))


def filename_of(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(_part(url, 3), r"/+$", ""), "/"), -1)
    return F.coalesce(F.try_url_decode(last), last)


def message_link(text: Column) -> Column:
    """struct(url, note): the first http(s) word of a message without trailing signs, and what else it says."""
    word = F.regexp_extract(text, r"(?i)(https?://\S+)", 1)
    bare = F.regexp_replace(word, r"[.,;:!?'\"»”]+$", "")
    for _ in range(3):  # a closing bracket that was opened before the link isn't part of it
        open_ = F.regexp_count(bare, F.lit(r"\(")) < F.regexp_count(bare, F.lit(r"\)"))
        bare = F.when(open_, F.regexp_replace(bare, r"\)$", "")).otherwise(bare)
    note = F.trim(F.regexp_replace(F.replace(text, word, F.lit(" ")), r"\s+", " "))
    return F.struct(F.nullif(bare, F.lit("")).alias("url"), F.substring(F.when(word == "", F.trim(text)).otherwise(note), 1, 500).alias("note"))
