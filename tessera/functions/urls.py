"""URL expressions, and what is found in the HTML of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of what pages hold.
PATTERNS = {
    "video": r"""(?i)(?:https?:)?\\?/\\?/[^"'\s<>]+\.(?:m3u8|mp4|webm)(?:[?&#][^"'\s<>]*)?""",
    "image": r"""(?i)(?:https?:)?\\?/\\?/[^"'\s<>]+\.(?:jpg|jpeg|png|pnj|webp|gif|avif)(?:[?&#][^"'\s<>]*)?""",
    "source": r"""(?i)(?:src|data-src|data-original|data-highres|data-image)=["']([^"']+)["']""",
    "srcset": r"""(?i)(?:srcset|data-srcset)=["']([^"']+)["']""",
    "title": r"""(?i)<title[^>]*>(.*?)</title>""",
    "link_next": r"""(?i)<link\s+[^>]*rel=["']next["'][^>]*href=["']([^"']+)["']""",
    "link_next_reversed": r"""(?i)<link\s+[^>]*href=["']([^"']+)["'][^>]*rel=["']next["']""",
    "anchor_next": r"""(?i)<a\s+[^>]*(?:rel=["']next["']|aria-label=["']Next(?: Page)?["'])[^>]*href=["']([^"']+)["']""",
    "anchor_class_next": r"""(?i)<a\s+[^>]*class=["'][^"']*\bnext\b[^"']*["'][^>]*href=["']([^"']+)["']""",
    "anchor": r"""(?i)<a\s+[^>]*href=["']([^"'#\s]+)["']""",
    "post_path": r"""(?i)/(?:post|posts|p|entry|watch|video|thread|status|item|detail|article)/[a-zA-Z0-9_\-\.]+""",
    "iframe": r"""(?i)<iframe\s+[^>]*(?:src|data-src)=["']([^"']+)["']""",
    "time": r"""(?i)<time\s+[^>]*datetime=["']([^"']+)["']""",
    "description": r"""(?i)<meta\s+[^>]*(?:name=["']description["']|property=["']og:description["'])[^>]*content=["']([^"']+)["']""",
    "tag": r"""(?i)<a\s+[^>]*href=["'][^"']*/(?:tag|tags)/([^"'/?#]+)["'][^>]*>""",
    "video_poster": r"""(?i)<video[^>]*(?:poster|data-poster)=["']([^"']+)["']""",
    "meta_poster": r"""(?i)<meta\s+[^>]*(?:property=["'](?:og:image|og:image:url)["']|name=["'](?:twitter:image|thumbnail)["'])[^>]*content=["']([^"']+)["']""",
    "json_poster": r"""(?i)["'](?:poster|thumbnailUrl|thumbnail|preview_image)["']\s*:\s*["']([^"']+)["']""",
}
# Parts of links that are no posts, and hosts of embedded players.
NOT_POSTS = ("/login", "/signup", "/register", "/logout", "/terms", "/privacy", "/about", "/contact", "/search", "/tag/", "/settings")
PLAYERS = ("youtube.com/embed", "youtu.be", "player.vimeo.com", "redgifs.com/ifr", "streamable.com/e/", "megacloud", "rabbitstream")


def found(html: Column, name: str, group: int = 1) -> Column:
    """The first match of a named pattern, null without one."""
    return F.nullif(F.regexp_extract(html, PATTERNS[name], group), F.lit(""))


def found_all(html: Column, name: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(PATTERNS[name]), F.lit(group))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def normalized(raw: Column) -> Column:
    """Escapes of slashes, ampersands and quotes undone, quotes, backslashes and spaces trimmed."""
    out = raw
    for a, b in (("\\/", "/"), ("&amp;", "&"), ("&quot;", ""), ("&#38;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.btrim(out, F.lit("\"'\\ "))


def _plain(base: Column, t: Column) -> Column:
    """The absolute URL of a normalized target, with the dots that it has."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(origin, F.regexp_extract(F.regexp_replace(F.substr(base, F.length(origin) + 1), "[?#].*$", ""), r"^(.*/)", 1))
    folder = F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder)
    return (
        F.when(t.rlike("^https?://"), t)
        .when(t.startswith("//"), F.concat(F.when(base.startswith("http://"), "http:").otherwise("https:"), t))
        .when(origin == "", t)
        .when(t.startswith("/"), F.concat(origin, t))
        .when(t.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), t))
        .when(t.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), t))
        .otherwise(F.concat(folder, t))
    )


def without_dots(url: Column) -> Column:
    """An absolute URL with . and .. segments of its path taken out; others stay as they are."""
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    steps = F.split(F.substr(path, F.lit(2)), "/")
    walk = lambda at, s: F.when(s == "..", F.regexp_replace(at, "/[^/]*$", "")).when(s == ".", at).otherwise(F.concat(at, F.lit("/"), s))
    end = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    plain = F.concat(origin, F.aggregate(steps, F.lit(""), walk), end, F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1))
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/\.\.?(/|$|[?#])"), plain).otherwise(url)


def resolved_all(base: Column, targets: Column) -> Column:
    """Absolute URLs of an array of targets: absolute and host-relative ones, root paths and sibling paths, by expressions only."""
    # Step by step, so that what a step makes is made once however often the next one names it.
    return F.transform(F.transform(F.transform(targets, normalized), lambda t: _plain(base, t)), without_dots)


def resolved(base: Column, target: Column) -> Column:
    """The absolute URL of a target."""
    return F.get(resolved_all(base, F.array(target)), F.lit(0))


resolve_dots = resolved


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def post_links(url: Column, html: Column, need_post_path: bool = True) -> Column:
    """Links to posts on the page's own host, once each in order."""
    full = resolved_all(url, found_all(html, "anchor"))
    ok = F.filter(
        full,
        lambda u: (host(u) == host(url))
        & (u != url)
        & ~((u.endswith("/")) & (F.rtrim(u, F.lit("/")) == url))
        & ~contains_any(F.lower(u), NOT_POSTS)
        & (u.rlike(PATTERNS["post_path"]) if need_post_path else F.lit(True)),
    )
    return F.array_distinct(ok)


def next_page(url: Column, html: Column) -> Column:
    """The next page: a link, its attributes reversed, an anchor by relation or class, or the page number plus one if the page mentions that."""
    links = [resolved(url, found(html, n)) for n in ("link_next", "link_next_reversed")]
    anchors = [F.when(resolved(url, found(html, n)) != url, resolved(url, found(html, n))) for n in ("anchor_next", "anchor_class_next")]
    number = r"[?&](page|p|pg)=(\d+)(?:&|#|$)"
    key, value = F.regexp_extract(url, number, 1), F.nullif(F.regexp_extract(url, number, 2), F.lit("")).cast("int") + 1
    text = value.cast("string")
    rest = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & (F.split_part(p, F.lit("="), F.lit(1)) != key))
    pairs = F.array_join(F.concat(rest, F.array(F.concat(key, F.lit("="), text))), "&")
    counted = F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("?"), pairs)
    mentioned = html.contains(F.concat(F.lit("page="), text)) | html.contains(F.concat(F.lit("p="), text))
    return F.coalesce(*links, *anchors, F.when(value.isNotNull() & mentioned, counted))


def tags(html: Column) -> Column:
    low = F.transform(found_all(html, "tag"), lambda t: F.lower(F.btrim(t)))
    return F.array_distinct(F.filter(low, lambda t: t != ""))


def players(url: Column, html: Column) -> Column:
    """Embedded players of known hosts."""
    full = resolved_all(url, found_all(html, "iframe"))
    return F.array_distinct(F.filter(full, lambda u: contains_any(F.lower(u), PLAYERS)))


def posters(url: Column, html: Column) -> Column:
    """Poster images: of video elements, of meta tags, of player settings; once each in that order."""
    settings = F.filter(F.transform(found_all(html, "json_poster"), lambda t: normalized(t)), lambda t: t.startswith("http") | t.startswith("/"))
    every = F.concat(found_all(html, "video_poster"), found_all(html, "meta_poster"), settings)
    return F.array_distinct(resolved_all(url, every))


def srcset_urls(html: Column) -> Column:
    """The URLs of all srcset entries."""
    entries = F.flatten(F.transform(found_all(html, "srcset"), lambda s: F.split(s, ",")))
    return F.filter(F.transform(entries, lambda e: F.split_part(F.btrim(e), F.lit(" "), F.lit(1))), lambda u: u != "")


def media_urls(url: Column, html: Column, name: str) -> Column:
    """All image or video URLs in the page's text, absolute, once each."""
    return F.array_distinct(resolved_all(url, found_all(html, name, 0)))


def url_stem(url: Column) -> Column:
    """File name up to its first dot, without digits, p and _ at its end; null if nothing is left."""
    name = F.element_at(F.split(F.split_part(url, F.lit("?"), F.lit(1)), "/"), -1)
    return F.nullif(F.regexp_replace(F.split_part(name, F.lit("."), F.lit(1)), "[0-9p_]+$", ""), F.lit(""))


def poster_of(video: Column, images: Column) -> Column:
    """The first image with the video's stem in it, if that has 4 characters or more; else the first image."""
    stem = url_stem(video)
    hit = F.filter(images, lambda i: i.contains(stem))
    return F.coalesce(F.when(F.char_length(stem) >= 4, F.get(hit, F.lit(0))), F.get(images, F.lit(0)))
