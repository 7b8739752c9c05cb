"""Main text of web pages, by two passes over their blocks.

A page is cut at block tags. The first pass labels the blocks that tell enough by themselves: those in containers that by
tag, role or class hold menus, adverts, comments and the like are left out, and so are those made of links; those long
enough with enough stop words are text. Long ones with few stop words but without links (code, another language) are ambiguous. The second pass gives each ambiguous block, mostly a short one, the label of its
nearest decided neighbour, in its own zone (an article element or the like) if there is one. If most of the text lies in
such zones, what lies outside them goes.

Defined results: a null or empty page, and one without text, gives an empty text; a page of short blocks alone keeps what no
container marks; markup may be broken in any way; a comment, script or style that is not closed takes the rest of the page;
pages of any length are read whole; rows that repeat, columns with other names and empty tables stay as they are. White
space is what str.split() takes for it, after character references are decoded.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tramline.llm.batches import slices, texts

# Stop words of some languages.
STOP_WORDS = frozenset(
    (
        "a about after all also am an and any are as at be been before but by can could did do does for from had has have he her his how i if in into is it its more no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
        "aber als am an auch auf aus bei bin bis da das dass dem den der des die dies diese dieser doch du durch ein eine einem einen einer eines er es für haben hat ich ihr im in ist ja kann mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wenn werden wie wir wird zu zum zur "
        "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur un une vous à été être "
        "al como con cuando de del desde donde el ella ellos en entre era es esta este esto está fue ha hay la las le lo los me mi más muy no nos o para pero por porque que se ser si sin sobre son su sus también tiene un una uno y ya "
        "che con da dei del della delle di e gli ha i il io la le lo ma nel nella non per più se si sono su un "
        "ao aos as com da das do dos em foi mais mas na nas nos não os ou pela pelo por são uma um "
        "aan dat de die een er het in is maar met naar niet of om ook op te van voor was wat zijn"
    ).split()
)

SHORT_CHARS, MOST_LINKED, LEAST_STOPS = 70, 1 / 3, 0.12
MOST_OF_TEXT = 0.5

DROPPED = frozenset("script style noscript template iframe object svg canvas select button textarea title audio video noframes noembed xmp datalist map embed applet".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header main menu nav ol search section table ul".split())
#: Other elements of these names end the open ones inside them; their kind is told by class too.
OUTSIDE = frozenset("aside dialog footer form menu nav search".split())
ROLES = {r: "out" for r in "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()} | {"main": "in", "article": "in"}
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion promotions recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
TALK = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
TEXTUAL = (frozenset("article post entry story main page news blog".split()), frozenset("body content text main article".split()))

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?(?=[\s/]|$)""", re.I)
_CAMEL = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in DROPPED}
_WORD = re.compile(r"[^\W\d_]+")
_BREAKS = re.compile(r"(?:\s*\0\s*){2,}")


def _kind(tag: str, attributes: str, within: str) -> str:
    """in (text), out (left out), talk (readers' comments) or, mostly, the kind of the container that it lies in."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(values))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    if within == "talk" or hidden:
        return "talk"
    named = f"{found.get('class', '')} {found.get('id', '')}"
    marks = frozenset(w.lower() for w in _CAMEL.findall(named))
    if marks & TALK and tag not in ("body", "main"):
        return "talk"
    role = ROLES.get(found.get("role", "").lower())
    if tag in ("article", "main") or role == "in" or found.get("itemprop", "").lower() == "articlebody":
        return "in"
    if tag == "body":
        return within
    if tag in OUTSIDE or role == "out" or (tag == "header" and within != "in"):
        return "out"
    textual = bool(marks & TEXTUAL[0]) and bool(marks & TEXTUAL[1])
    if within != "out" and (textual or named.strip().lower() in ("article", "content")):
        return "in"
    if marks & MARKED or ("header" in marks and within != "in" and not marks & TEXTUAL[0]):
        return "out"
    return within


def blocks_of(page: str) -> list[tuple[str, int, str, int, bool]]:
    """Blocks in page order: text, characters of it in links, kind of the container, number of the zone, whether a heading."""
    found: list[tuple[str, int, str, int, bool]] = []
    parts: list[str] = []
    linked = in_link = zones = 0
    heading = False
    stack: list[tuple[str, str, int]] = [("", "", 0)]

    def close() -> None:
        nonlocal linked
        if parts:
            whole = html.unescape("".join(parts))
            for one in _BREAKS.split(whole) if "\0" in whole else (whole,):
                text = " ".join(one.replace("\0", " ").split())
                if text:
                    found.append((text, min(linked, len(text)), stack[-1][1], stack[-1][2], heading))
            parts.clear()
        linked = 0

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        upto = token.start() if token else len(page)
        if upto > at:
            piece = page[at:upto].replace("\0", "�")
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        ends = bool(token[1])
        if tag in DROPPED:
            if not ends and not token[3].endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag == "a":
            in_link = 0 if ends else 1
        elif tag == "br":
            parts.append("\0")
        elif tag in BLOCKS:
            close()
            heading = not ends and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag in CONTAINERS:
                if not ends:
                    kind = _kind(tag, token[3], stack[-1][1])
                    if kind == "in" and stack[-1][1] != "in":
                        zones += 1
                    stack.append((tag, kind, zones if kind == "in" else stack[-1][2] if kind == stack[-1][1] else 0))
                    in_link = 0
                elif any(t == tag for t, _, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
    close()
    return found


def _decided(text: str, linked: int, kind: str) -> bool | None:
    """Whether a block is text, if it tells that by itself."""
    if kind in ("out", "talk"):
        return False
    inside = kind == "in"
    if linked > MOST_LINKED * len(text):
        return None if inside and linked < len(text) else False
    if not inside and "©" in text:
        return False
    if len(text) < SHORT_CHARS:
        return None
    words = _WORD.findall(text.lower())
    if words and sum(w in STOP_WORDS for w in words) >= LEAST_STOPS * len(words):
        return True
    return None if inside or not linked else False


def main_blocks(page: str) -> list[str]:
    """The blocks of a page's main text, in page order."""
    blocks = [b for b in blocks_of(page)]
    labels = [_decided(text, linked, kind) for text, linked, kind, _, _ in blocks]
    text_in = lambda where: sum(len(b[0]) for b, label in zip(blocks, labels, strict=True) if label and where(b))
    zoned = text_in(lambda b: b[2] == "in")
    whole = text_in(lambda b: True)
    only_zones = any(b[2] == "in" for b in blocks) and zoned >= MOST_OF_TEXT * whole

    def near(order: range, same_zone: bool) -> list[tuple[int, bool] | None]:
        """For each block, how far back in this order the nearest decided one is, and its label."""
        last: dict[int, tuple[int, bool]] = {}
        got: list[tuple[int, bool] | None] = [None] * len(blocks)
        for step, k in enumerate(order):
            _, _, kind, zone, _ = blocks[k]
            key = zone if same_zone else 0
            if key in last:
                got[k] = (step - last[key][0], last[key][1])
            if labels[k] is not None and kind not in ("out", "talk"):
                last[key] = (step, labels[k])
        return got

    onward, backward = range(len(blocks)), range(len(blocks) - 1, -1, -1)
    by_zone, by_page = (list(zip(near(onward, same), near(backward, same), strict=True)) for same in (True, False))
    kept = []
    for k, (text, _, kind, _, heading) in enumerate(blocks):
        label = labels[k]
        if label is None:
            inside = kind == "in"
            before, after = by_zone[k] if inside or any(by_zone[k]) else by_page[k]
            both = [x for x in (before, after) if x]
            if heading and after and after[1]:
                label = True
            elif not both:
                label = True
            elif len(both) == 2 and both[0][0] == both[1][0]:
                label = inside or (both[0][1] and both[1][1])
            else:
                label = min(both)[1] or (inside and not any(x[1] for x in both))
        if label and (kind == "in" or not only_zones):
            kept.append(text)
    return kept


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page or ""))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        found = [main_text(t) for t in texts(batch, "html")]
        keep = [n for n in batch.schema.names if n != "html"]
        columns = [batch.column(n) for n in keep] + [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page (page_id, url, html)."""
    wanted = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}
    return wanted.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
