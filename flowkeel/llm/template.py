"""Main text of web pages by deducing each host's template from equivalence classes.

A token is an element's path from the root (tag and first word of its names), or a run of text
with the path that holds it; text formatting is not part of a path. The tokens of a host that
occur equally often in each of its pages share their occurrence vector and form a class. A
class is valid if its tokens occur once in every page that has them. Paths nest the classes.

The main slot is the deepest valid element that holds all text outside boilerplate elements of
the outermost article or main with most of the host's text, or of the page where there is none.
A page that lacks its host's main slot falls back to its own article, main or body.

Text in the slot is template text if its class is valid, holds an element too, and covers half of
the host's pages, at least three, not all copies of one. A page keeps the texts of a class that come in
another order than on the host as a whole. Headings and labels of tables and lists stay, and
so does all text where more than half of the slot's would go: such pages are near-copies.
Boilerplate tags and names are dropped besides. Inside an article, names that may as well be its own words
count if the marked element repeats like template text or, on hosts of any size, if the name says nothing
else (`user-comments`, not `comments-on-the-proof`) and there is more text beside: always for
readers' remarks, for other parts if they hold at most half as much as what is beside them.

A vector is carried as the sum of 62-bit hashes of (page, count), so hosts of any size meet
as sums, made in each task before the shuffle.

Defined cases: null and empty html give empty text. A null URL counts as the empty host.
Markup cut short by the page's end is dropped, elements left open end with their
parent. Rows that repeat a page are pages of their own. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowkeel.llm import text as T
from flowkeel.llm.frames import lower_ascii, sized
from flowkeel.session import materialise, ship_package

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|(?=[\"']))", re.S)
#: Elements whose content is text up to their end tag.
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot
th thead tr ul""".split())
#: Start tags that end an open element of these kinds, within the nearest enclosing holder.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
          "option": ({"option"}, {"select"})}
BOILERPLATE = frozenset("""nav footer aside form script style noscript template iframe button select option textarea head title svg
canvas object embed dialog menu xmp noembed noframes input""".split())
#: Words of class, id and role attributes that mark boilerplate.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies
share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo""".split())
#: Marks that articles use for parts of their own too.
AMBIGUOUS = frozenset("""comment comments menu navigation notice notices promo related replies share sharing social sponsor toolbar
widget""".split())
#: Marks of what readers say.
REMARKS = frozenset("comment comments disqus replies".split())
#: Words that say in a name how a part is laid out or whose it is, not what it is about.
LAYOUT = frozenset("""area articles bar block box btn button buttons container content footer group header icons inner items left
line link links list main module outer page panel post posts reader readers right row section site slot stories
thread top unit user users wrap wrapper""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are content inside an article or main, whatever their names.
PROSE = frozenset("p pre blockquote figure figcaption table caption thead tbody tfoot tr td th dl dt dd li".split())
#: Elements whose text says what the text beside it is, and so stays on every page.
LABELS = HEADINGS | frozenset("caption dt figcaption legend summary td th".split())
HEADERS = frozenset(["header"])
CONTENT = ("article", "main")
LEAST_PAGES = 3
#: Kinds of tokens.
ELEMENT, TEXT, SUSPECT = 0, 1, 2
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s\"'/]|$)", re.I)


class Page:
    """Counts and places of the page's elements, and its texts with their element, block and standing."""

    def __init__(self, source: str):
        self.counts: dict[str, int] = {}
        self.places: dict[str, int] = {}
        self.suspects: set[str] = set()
        #: Suspects whose name says nothing else, with whether it means readers' remarks.
        self.plain: dict[str, bool] = {}
        #: Block number, boilerplate, path, text, suspect elements around it, place.
        self.texts: list[tuple[int, bool, str, str, tuple[str, ...], int]] = []
        stack: list[tuple[str, str, bool, tuple[str, ...]]] = []  # tag, path, boilerplate, suspects
        block, at, n = 0, 0, len(source)
        path, off, held = "", False, ()

        def say(raw: str) -> None:
            if raw:
                self.texts.append((block, off, path, html.unescape(raw), held, len(self.texts) + len(self.places)))

        def leave(k: int) -> None:
            nonlocal block, path, off, held
            if any(entry[0] in BLOCK for entry in stack[k:]):
                block += 1
            del stack[k:]
            path, off, held = stack[-1][1:] if stack else ("", False, ())

        while at < n:
            m = MARKUP.search(source, at)
            if not m:
                say(source[at:])
                break
            say(source[at:m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if k is not None:
                    leave(k)
                elif tag in BLOCK:
                    block += 1
                continue
            if tag in BLOCK:
                self.close(stack, {"p"}, {"article", "body", "div", "section", "td", "th", "li", "table"}, leave)
                block += 1
            if tag in CLOSES:
                self.close(stack, *CLOSES[tag], leave)
            words, whole, hidden = self.names(m[3])
            inside = any(entry[0] in CONTENT for entry in stack)
            drops = tag in BOILERPLATE and not (tag == "svg" and inside)
            marked, suspect, plain = self.standing(tag, words, whole, inside)
            own = tag in BLOCK or tag in BOILERPLATE or bool(suspect)
            name = f"{path}/{tag}{'.' + (suspect or words[0]) if words else ''}" if own else path
            if own:
                self.counts[name] = self.counts.get(name, 0) + 1
                self.places.setdefault(name, len(self.texts) + len(self.places))
            around = held
            if suspect:
                self.suspects.add(name)
                if plain:
                    self.plain[name] = not REMARKS.isdisjoint(named(suspect))
                around = (*held, name)
            out = off or hidden or drops or marked or (tag in HEADERS and not inside)
            if tag in VOID:
                if tag in ("br", "hr"):
                    say(" ")
                continue
            if tag in RAW:
                end = RAW[tag].search(source, at)
                at = end.start() if end else n
                stack.append((tag, name, True, around))
                path, off, held = name, True, around
                continue
            stack.append((tag, name, out, around))
            path, off, held = name, out, around

    @staticmethod
    def close(stack, kinds, holders, leave) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in kinds:
                leave(k)
                return
            if stack[k][0] in holders:
                return

    @staticmethod
    def names(attributes: str) -> tuple[list[str], list[str], bool]:
        """Words of the element's names, the names themselves, and whether it is hidden."""
        if not attributes:
            return [], [], False
        words, whole, hidden = [], [], False
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                hidden = True
            else:
                words += re.findall(r"[a-z0-9]+", value)
                whole += value.split()
        return words, whole, hidden

    @staticmethod
    def standing(tag: str, words: list[str], whole: list[str], inside: bool) -> tuple[bool, str, bool]:
        """Whether the names mark boilerplate by themselves; or else the name that needs more evidence, and whether it is plain:
        made of marks and words of layout alone, so that the page's own evidence will do."""
        if not words or tag in ("html", "body", "main") or tag in HEADINGS:
            return False, "", False
        plain = [w for w in whole if is_plain(w)]
        if tag == "article":
            plain = [w for w in plain if not REMARKS.isdisjoint(named(w))]
        if inside and tag in PROSE and tag != "p":
            plain = [w for w in plain if AMBIGUOUS.isdisjoint(named(w))]
        if any((w in MARKS and not (inside and w in AMBIGUOUS)) or (not inside and not REMARKS.isdisjoint(named(w))) for w in plain):
            return True, "", False
        if plain:
            return False, plain[0].replace("/", "-"), True
        if tag == "article" or (inside and tag in PROSE):
            return False, "", False
        return False, next((w for w in whole if not MARKS.isdisjoint(named(w))), "").replace("/", "-"), False

    def held(self) -> dict[str, int]:
        """Characters outside boilerplate under every path, the whole page's under the empty one."""
        sizes = {"": 0}
        for _, off, path, text, _, _ in self.texts:
            if not off:
                size = len(text.strip())
                sizes[""] += size
                while path:
                    sizes[path] = sizes.get(path, 0) + size
                    path = path.rpartition("/")[0]
        return sizes

    def own_slot(self) -> str:
        """The outermost article or main with most of the page's text; without one all of the page."""
        sizes = self.held()
        return min((p for p in self.counts if tag_of(p) in CONTENT and 2 * sizes.get(p, 0) > sizes[""]),
                   key=lambda p: (p.count("/"), p), default="")

    def text_tokens(self) -> Iterator[tuple[int, str]]:
        """Index and token of every text that may be template text."""
        for i, (_, off, path, text, _, _) in enumerate(self.texts):
            if not off and not text.isspace() and tag_of(path) not in LABELS:
                yield i, path + "\0" + hashlib.blake2b(" ".join(text.split()).encode("utf-8", "replace"), digest_size=8).hexdigest()

    def template(self, classed: list[dict]) -> set[int]:
        """Indexes of the texts that belong to the host's template, given in its order."""
        where = {token: i for i, token in self.text_tokens()}
        last: dict[str, int] = {}
        broken: set[str] = set()
        got: list[tuple[str, int]] = []
        for t in classed:
            i = where.get(t["token"])
            if i is not None:
                if i < last.get(t["class"], -1):
                    broken.add(t["class"])
                last[t["class"]] = i
                got.append((t["class"], i))
        return {i for c, i in got if c not in broken}

    def remarks(self, slot: str, gone: set[int]) -> set[str]:
        """Elements in the slot that go on the page's own evidence: readers' remarks, and other plainly named parts with at most
        half of the text beside them. None go where nothing would be left."""
        if not self.plain:
            return set()
        beside, sizes = 0, dict.fromkeys(self.plain, 0)
        for i, (_, off, path, text, held, _) in enumerate(self.texts):
            if off or i in gone or not within(path, slot):
                continue
            around = [h for h in held if h in self.plain and within(h, slot)]
            size = len(text.strip())
            if not around:
                beside += size
            for h in around:
                sizes[h] += size
        return {h for h, size in sizes.items() if beside and within(h, slot) and (self.plain[h] or 2 * size <= beside)}

    def main(self, slot: str | None, classed: list[dict] | None = None, marks: list[str] | None = None) -> str:
        """Text under the slot, block by block; a page without it uses its own content element."""
        if slot is None or (slot and slot not in self.counts):
            slot = self.own_slot()
        gone = self.template(classed) if classed else set()
        dropped = set(marks or ()) | self.remarks(slot, gone)
        blocks: dict[int, list[str]] = {}
        for i, (block, off, path, text, held, _) in enumerate(self.texts):
            if not off and i not in gone and within(path, slot) and dropped.isdisjoint(held):
                blocks.setdefault(block, []).append(text)
        clean = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n\n".join(b for b in clean if b)


@lru_cache(maxsize=4096)
def named(name: str) -> frozenset[str]:
    """The words of one name."""
    return frozenset(re.findall(r"[a-z0-9]+", name))


@lru_cache(maxsize=4096)
def is_plain(name: str) -> bool:
    """Whether a name is made of marks and, besides, words of layout and numbers alone."""
    words = named(name)
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in LAYOUT or w.isdigit() for w in words)


def within(path: str, slot: str) -> bool:
    return not slot or path == slot or path.startswith(slot + "/")


def tag_of(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


SUMS = ("pages", "v1", "v2", "size", "place")
TOKENS = "host string, token string, kind int, " + ", ".join(f"{c} long" for c in (*SUMS, "most", "low", "high"))


def page_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token, summed over a batch: pages, vector hash in two halves, text, place; most in a page, range of the pages' hashes."""
    for batch in T.blocks(batches, "html"):
        sums: dict[tuple[str, str], list[int]] = {}
        for host, key, digest, source in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            page = Page(source or "")
            held = page.held()
            found = [(path, SUSPECT if path in page.suspects else ELEMENT, n, held.get(path, 0), page.places[path])
                     for path, n in page.counts.items()]
            found.append(("", ELEMENT, 1, held[""], 0))
            texts: dict[str, list[int]] = {}
            for i, token in page.text_tokens():
                t = texts.setdefault(token, [0, 0, page.texts[i][5]])
                t[0] += 1
                t[1] += len(page.texts[i][3].strip())
            found += [(token, TEXT, *t) for token, t in texts.items()]
            hashes: dict[int, tuple[int, int]] = {}
            for token, kind, n, size, place in found:
                if n not in hashes:
                    d = hashlib.blake2b(f"{key}:{n}".encode(), digest_size=8).digest()
                    hashes[n] = int.from_bytes(d[:4], "little"), int.from_bytes(d[4:], "little")
                s = sums.get((host, token))
                if s is None:
                    sums[host, token] = [kind, 1, *hashes[n], size, place, n, digest, digest]
                    continue
                s[1] += 1
                s[2] += hashes[n][0]
                s[3] += hashes[n][1]
                s[4] += size
                s[5] += place
                s[6] = max(s[6], n)
                s[7] = min(s[7], digest)
                s[8] = max(s[8], digest)
        yield pa.RecordBatch.from_pydict({
            "host": [k[0] for k in sums], "token": [k[1] for k in sums],
            **{c: [s[i] for s in sums.values()] for i, c in enumerate(("kind", *SUMS, "most", "low", "high"))}},
            schema=pa.schema([("host", pa.string()), ("token", pa.string()), ("kind", pa.int32()),
                              *[(c, pa.int64()) for c in (*SUMS, "most", "low", "high")]]))


def host_of(url: str):
    return lower_ascii(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def classes(pages: DataFrame) -> DataFrame:
    """host, token, kind, pages, class (its vector), class_size, class_elements, valid and sums for every token of every host.

    Texts are left out that cannot be template text.
    """
    digest = F.coalesce(F.xxhash64("html"), F.lit(0).cast("long"))
    tokens = pages.select("host", F.concat_ws(":", "page_id", digest).alias("key"), digest.alias("digest"), "html").mapInArrow(page_vector, TOKENS)
    t = tokens.groupBy("host", "token", "kind").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"))
    repeated = (F.col("pages") >= LEAST_PAGES) & (F.col("low") != F.col("high"))
    t = t.filter((F.col("kind") != TEXT) | ((F.col("most") == 1) & repeated))
    vector = Window.partitionBy("host", "pages", "v1", "v2")
    return t.withColumn("class_size", F.count("*").over(vector)).withColumn(
        "class_elements", F.sum((F.col("kind") != TEXT).cast("long")).over(vector)).withColumn(
        "class", F.concat_ws(":", "pages", "v1", "v2")).withColumn("valid", F.col("most") == 1).withColumn(
        "repeated", repeated).drop("v1", "v2", "low", "high")


def with_host(classed: DataFrame, support: float) -> DataFrame:
    """The tokens on at least `support` of their host's pages, with host_pages and host_size."""
    host = classed.groupBy("host").agg(F.max("pages").alias("host_pages"), F.max("size").alias("host_size"))
    return classed.join(host, "host").filter(F.col("pages") >= support * F.col("host_pages"))


def templates(classed: DataFrame, support: float = 0.5, share: float = 0.5) -> DataFrame:
    """The main slot of every host: host, slot."""
    depth = F.size(F.split("token", "/"))
    ok = with_host(classed, support).filter(F.col("valid") & (F.col("kind") == ELEMENT) & (F.col("size") > share * F.col("host_size")))
    tag = F.regexp_extract("token", r"([^/.]*)[^/]*$", 1)
    scope = ok.groupBy("host").agg(F.coalesce(F.min_by(F.when(tag.isin(*CONTENT), F.col("size")), F.when(
        tag.isin(*CONTENT), depth)), F.max("host_size")).alias("scope"))
    best = ok.join(scope, "host").filter(F.col("size") == F.col("scope")).groupBy("host").agg(
        F.max(F.struct(depth.alias("depth"), "class_size", "size", "token")).alias("b"))
    return best.select("host", F.col("b.token").alias("slot"))


def removed(classed: DataFrame, slots: DataFrame, support: float = 0.5, share: float = 0.5) -> DataFrame:
    """What hosts' pages lose inside their slots: host, texts (place, class, token in the template's order), marks."""
    seen = with_host(classed, support).filter("repeated")
    marks = seen.filter(F.col("kind") == SUSPECT).groupBy("host").agg(F.collect_set("token").alias("marks"))
    slot_size = slots.join(classed.select("host", F.col("token").alias("slot"), F.col("size").alias("slot_size")), ["host", "slot"])
    texts = seen.filter(F.col("valid") & (F.col("kind") == TEXT) & (F.col("class_elements") > 0)).join(slot_size, "host").filter(
        (F.col("slot") == "") | F.col("token").startswith(F.concat("slot", F.lit("/")))
        | F.col("token").startswith(F.concat("slot", F.lit("\0"))))
    texts = texts.groupBy("host").agg(
        F.sum("size").alias("size"), F.first("slot_size").alias("slot_size"),
        F.sort_array(F.collect_list(F.struct("place", "class", "token"))).alias("texts")).filter(
        F.col("size") <= share * F.col("slot_size")).select("host", "texts")
    return texts.join(marks, "host", "full")


def extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.blocks(batches, "html"):
        out = [Page(h or "").main(*t) for h, *t in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()),
                                          pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    ship_package(pages.sparkSession)
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of("url"))
    classed = materialise(classes(rows), "classes")
    slots = templates(classed)
    known = sized(materialise(slots.join(removed(classed, slots), "host", "left"), "templates"))
    return rows.join(known, "host", "left").select("page_id", "url", "html", "slot", "texts", "marks").mapInArrow(
        extractor, "page_id long, url string, text string, n_chars long")
