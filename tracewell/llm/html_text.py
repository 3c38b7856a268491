"""Main text of web pages by a site style tree: what a site repeats is not the article."""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, slices, written
from tracewell.llm.grams import look_up

#: Decisions on branches sent to the workers at a time: 9 bytes each.
SHARD_ROWS = 4_000_000
#: A text goes if its branch's importance is below LOW and below SHARE times that of the content it lies in.
LOW, SHARE = 0.2, 0.5
#: A branch with more than MAIN of a page's content leads to the article; a container beside it with less than SMALL goes.
MAIN, SMALL = 0.5, 0.15
#: What a site says of a branch counts by its pages, what all sites say of the same path as if from so many pages.
POOL = 5
#: Characters that every page of a site has count for so little, not for nothing: a site may be copies of one article.
REPEATED = 0.1
#: Elements nested deeper share the branch of the one at this depth.
DEPTH = 200

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold text of an article, whatever a site's tree says.
NOISE = frozenset(
    "applet audio button canvas datalist dialog form frame frameset head iframe input label math noembed noframes "
    "noscript object script select style svg template textarea title video".split()
)
#: Block elements that are text in themselves; the others are containers.
TEXT = frozenset("address blockquote caption center dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr legend li p pre summary td th tr".split())
#: What an opening tag closes: an open element of these names, but not beyond those.
_P = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
CLOSES = {name: (frozenset(["p"]), frozenset("body button td th li article section div blockquote".split())) for name in _P} | {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "body": (frozenset(["head"]), frozenset(["html"])),
}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Class or id of reader comments.  They are as much a page's own as the article, so no importance tells them apart.
_COMMENTS = re.compile(r"(?:comments?|replies|disqus)(?:[-_].*)?", re.I)

#: Kinds of features.
TEXTS, STYLES, NODES, ABOVE = range(4)
#: What is decided of a branch.
REPEATS, LITTLE, LEADS = 1, 2, 4


def key_of(*parts: object) -> int:
    """64 bits that stand for the parts, as a signed integer."""
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Node:
    """An element: its path of block elements with classes, equal siblings on one path."""

    __slots__ = ("name", "path", "noise", "link", "children")

    def __init__(self, name: str, path: tuple[str, ...], noise: bool, link: bool):
        self.name, self.path, self.noise, self.link, self.children = name, path, noise, link, []


class Page:
    """The blocks of a page in order, and the sequences of child elements of its branches.

    ``blocks`` has (path, text, link characters) with white space collapsed; ``styles``
    (path, labels of the child elements).  Text in noise is not there.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []
        self.styles: set[tuple[tuple[str, ...], str]] = set()
        self.text: list[str] = []
        self.links = 0
        self.stack = [_Node("", (), False, False)]
        at = 0
        while found := _MARKUP.search(source, at):
            self._text(source[at : found.start()])
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if found[1] or found[4]:
                self._close(name)
                continue
            self._open(name, found[3] if found[2] else found[6])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                self._text(source[at : end.start()])
                at = end.end()
                self._close(name)
        self._text(source[at:])
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _text(self, raw: str) -> None:
        if raw and not self.stack[-1].noise:
            self.text.append(html.unescape(raw) if "&" in raw else raw)
            if self.stack[-1].link:
                self.links += len(self.text[-1])

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        links, self.text, self.links = min(self.links, len(text)), [], 0
        if text:
            holder = next(n for n in reversed(self.stack) if n.name in BLOCK or not n.name)
            self.blocks.append((holder.path, text, links))

    def _open(self, name: str, attributes: str) -> None:
        if name in CLOSES:
            closed, stops = CLOSES[name]
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name in closed:
                    while len(self.stack) > i:
                        self._pop()
                elif self.stack[i].name in stops:
                    break
        if name == "br":
            self._text("\n")
            return
        parent = self.stack[-1]
        label, noise = name, name in NOISE
        if attributes and attributes.strip(" /"):
            own = {a.lower(): html.unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(attributes)}
            classes = own.get("class", "").lower().split()
            if name not in ("html", "body"):
                noise = noise or any(_COMMENTS.fullmatch(x) for x in (*classes, own.get("id", ""))) or "hidden" in own or own.get("aria-hidden") == "true"
                noise = noise or "display:none" in own.get("style", "").replace(" ", "").lower()
            if classes:
                label = ".".join([name, *sorted(classes)])
        if name in BLOCK:
            self._flush()
            parent.children.append(label)
        if name in VOID:
            return
        path = (*parent.path, label) if name in BLOCK and len(parent.path) < DEPTH else parent.path
        self.stack.append(_Node(name, path, noise or parent.noise, parent.link or name == "a"))

    def _close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                while len(self.stack) > i:
                    self._pop()
                return
        if name == "br":
            self._text("\n")

    def _pop(self) -> None:
        node = self.stack[-1]
        if node.name in BLOCK:
            self._flush()
            if node.children and not node.noise:
                self.styles.add((node.path, " ".join(node.children)))
        self.stack.pop()


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; "" if it has none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


@functools.lru_cache(1 << 14)
def lineage(host: str, path: tuple[str, ...]) -> tuple[tuple[int, int, int], ...]:
    """(branch of the site, path without the site, whether a container may go by its share) from the root to the path."""
    out, inside = [(key_of(host), key_of("path"), 0)], False
    for i, label in enumerate(path, 1):
        name = label.split(".")[0]
        out.append((key_of(host, *path[:i]), key_of("path", *path[:i]), int(not inside and name not in TEXT and name not in ("html", "body"))))
        inside = inside or name in ("article", "main")
    return tuple(out)


_FEATURES = ["branch", "kind", "feature"]
_SUMS = ["pages", "chars", "own_chars"]
_MARKS = ["site", "path", "container"]


def _features(df: DataFrame, url: str, source: str) -> DataFrame:
    """What the branches of all pages have, and in how many pages.

    A branch has texts (``feature`` is the text, with its characters and those outside
    links), styles (the sequence of child elements), branches above it, itself
    included, and for the tree's node the branch it hangs from, its site and path,
    with the characters outside links of the pages that have it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            counts: dict[tuple, list[int]] = {}
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, page = host_of(u), Page(h or "")
                own: dict[tuple, tuple[int, int]] = {}
                root, whole = lineage(host, ())[0], sum(len(t) - n for (_, t), n in {(p, t): n for p, t, n in page.blocks}.items())
                own[root[0], NODES, 0, root[0], root[1], 0] = 0, whole
                for path, text, links in page.blocks:
                    line = lineage(host, path)
                    key = (line[-1][0], TEXTS, key_of(text), 0, 0, 0)
                    if key in own:
                        continue
                    own[key] = len(text), len(text) - links
                    for i, (branch, plain, container) in enumerate(line):
                        own[line[-1][0], ABOVE, branch, 0, i, 0] = 0, 0
                        if i:
                            own[branch, NODES, line[i - 1][0], root[0], plain, container] = 0, whole
                for path, style in page.styles:
                    own[lineage(host, path)[-1][0], STYLES, key_of(style), 0, 0, 0] = 0, 0
                for key, (chars, mine) in own.items():
                    sums = counts.setdefault(key, [0, 0, 0])
                    sums[0] += 1
                    sums[1] += chars
                    sums[2] += mine
            rows = [(b, k, f, *sums, site, path, c) for (b, k, f, site, path, c), sums in counts.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*_FEATURES, *_SUMS, *_MARKS])

    found = map_batches(df.select(url, source), run, ", ".join(f"{n} long" for n in [*_FEATURES, *_SUMS, *_MARKS]))
    return found.groupBy(*_FEATURES).agg(*(F.sum(n).alias(n) for n in _SUMS), *(F.max(n).alias(n) for n in _MARKS))


def site_trees(df: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """The branches of each site's style tree: branch, parent, ``pages``, ``importance``, ``around``, ``share``, ``leaf``, ``container``, ``leads``.

    * A text on p of a site's m pages has the weight 1 - log_m p: 1 on one page, 0 on
      all.  A branch's content importance is the mean weight of all texts in it times
      the share of its characters outside links; its presentation importance the
      entropy to the base m of its sequences of child elements; ``importance`` is the
      larger of both.
    * ``share`` is what part of a page's content a branch holds on the pages that have
      it: characters outside links, weighted as above but at least by REPEATED, against
      all characters of these pages at the site's mean weight.
    * A site's few pages say little, so both are drawn towards the means of the same
      path on all sites, these counting as POOL pages.
    * ``leads``: the branch holds other branches and more than MAIN of the content.
      ``around`` is the importance of the deepest such branch above.
    """
    found = written(_features(df, url, source), "features")
    nodes = found.where(F.col("kind") == NODES).select("branch", F.col("feature").alias("parent"), "site", "path", "container", "pages", F.col("own_chars").alias("around_it"))
    texts = found.where(F.col("kind") == TEXTS).groupBy("branch").agg(
        F.sum("pages").alias("n"), F.sum(F.col("pages") * F.log("pages")).alias("spread"), F.sum("chars").alias("chars"),
        F.sum("own_chars").alias("own"), F.sum(F.col("own_chars") * F.log("pages")).alias("own_spread"),
    )
    styles = found.where(F.col("kind") == STYLES).groupBy("branch").agg(F.sum("pages").alias("s"), F.sum(F.col("pages") * F.log("pages")).alias("s_spread"))
    above = found.where(F.col("kind") == ABOVE).select("branch", F.col("feature").alias("above"), F.col("path").alias("depth"))
    held = above.join(texts, "branch").groupBy(F.col("above").alias("branch")).agg(
        *(F.sum(c).alias(c) for c in ("n", "spread", "chars", "own", "own_spread")), F.max((F.col("branch") != F.col("above")).cast("int")).alias("inner"),
        F.max((F.col("branch") == F.col("above")).cast("int")).alias("leaf"),
    )
    held = held.join(nodes, "branch").join(styles, "branch", "left")
    log_m = F.log(F.greatest("m", F.lit(2)))
    amount = ((F.col("own") * (1 + REPEATED) - F.col("own_spread") / log_m) / F.col("pages")).alias("amount")
    each = (F.col("around_it") / F.col("pages")).alias("each")  # characters of a page that has the branch
    sites = held.where("branch = site").withColumn("m", F.col("pages")).select("site", "m", F.try_divide(amount, each).alias("weight"))
    content = F.greatest(1 - F.col("spread") / F.col("n") / log_m, F.lit(0.0)) * F.col("own") / F.col("chars")
    shape = F.coalesce((F.log("s") - F.col("s_spread") / F.col("s")) / F.log(F.greatest("s", F.lit(2))), F.lit(0.0))
    rated = held.join(sites, "site").select(
        "branch", "parent", "site", "path", "container", "pages", "inner", "leaf",
        F.when(F.col("leaf") == 1, F.greatest(content, shape)).otherwise(content).alias("own_importance"),
        F.coalesce(F.try_divide(amount, each * F.col("weight")), F.lit(0.0)).alias("own_share"),
    )
    rated = written(rated, "rated")
    mean = lambda c: (F.sum(F.col(c) * F.col("pages")) / F.sum("pages")).alias(f"all_{c}")
    paths = rated.groupBy("path").agg(mean("own_importance"), mean("own_share"))
    drawn = lambda c: (F.col("pages") * F.col(f"own_{c}") + POOL * F.col(f"all_own_{c}")) / (F.col("pages") + POOL)
    pooled = rated.join(paths, "path").select("branch", "parent", "site", "container", "pages", "inner", "leaf", drawn("importance").alias("importance"), drawn("share").alias("share"))
    leads = ((F.col("inner") == 1) & (F.col("share") > MAIN)) | (F.col("branch") == F.col("site"))
    tree = written(pooled.withColumn("leads", leads), "trees")
    deepest = above.join(tree.where("leads").select(F.col("branch").alias("above"), "importance"), "above")
    deepest = deepest.groupBy("branch").agg(F.max_by("importance", "depth").alias("around"))
    return tree.join(deepest, "branch", "left").select("branch", "parent", "pages", "importance", "around", "share", F.col("leaf") == 1, F.col("container") == 1, "leads").toDF(
        "branch", "parent", "pages", "importance", "around", "share", "leaf", "container", "leads"
    )


def _decisions(tree: DataFrame) -> DataFrame:
    """(branch, verdict) of the branches of which anything is decided, as bits."""
    low = F.col("leaf") & (F.col("importance") < LOW) & (F.col("importance") < SHARE * F.col("around"))
    small = F.col("container") & (F.col("share") < SMALL)
    bits = F.when(low, REPEATS).otherwise(0) + F.when(small, LITTLE).otherwise(0) + F.when(F.col("leads"), LEADS).otherwise(0)
    return tree.select("branch", F.coalesce(bits, F.lit(0)).cast("byte").alias("verdict")).where("verdict > 0")


def _main_text(host: str, blocks: list[tuple[tuple[str, ...], str, int]], verdicts: dict[int, int]) -> str:
    """The blocks that stay: see ``extract_text``."""
    lines = [[branch for branch, _, _ in lineage(host, path)] for path, _, _ in blocks]
    beside = {line[i - 1] for line in lines for i in range(1, len(line)) if verdicts.get(line[i], 0) & LEADS}

    def stays(line: list[int]) -> bool:
        return not verdicts.get(line[-1], 0) & REPEATS and not any(verdicts.get(b, 0) & LITTLE and line[i] in beside for i, b in enumerate(line[1:]))

    return "\n\n".join(text for line, (_, text, _) in zip(lines, blocks, strict=True) if stays(line))


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, ``text`` and ``n_chars``: the main text of every page from its whole html.

    The whole DOM of every page, but what holds no text of an article (scripts, forms,
    hidden elements, reader comments by their class), is merged into its site's style
    tree (``site_trees``).  From a page go

    * the texts of branches of low importance: below LOW, and below SHARE times that of
      the main content around them, so that an article that all pages share stays;
    * containers (``div``, ``nav``, ``footer`` and the like, not paragraphs or headings)
      with less than SMALL of the content, where the page has a branch beside them that
      holds most of it.  Inside an ``article`` or ``main`` only the first rule holds.

    Branches are counted over all pages of a host by keys, summed within tasks first,
    so a host of any number of pages is no task's burden.  The decisions come back to
    the pages in shards of SHARD_ROWS; pages are never shuffled.  A null or empty page,
    or one without text, has text "".  Pages without a host are one site.  Repeated
    rows give repeated rows.
    """
    decided = written(_decisions(site_trees(df, url, source)), "decisions")
    shards = max(1, -(-decided.count() // SHARD_ROWS))
    held = []
    for i in range(shards):
        part = (decided if shards == 1 else decided.where(F.pmod("branch", F.lit(shards)) == i)).toArrow().sort_by("branch")
        held.append(df.sparkSession.sparkContext.broadcast((part.column("branch").to_numpy(), part.column("verdict").to_numpy())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            pages = [(host_of(u), Page(h or "").blocks) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            branches = np.array(sorted({b for host, blocks in pages for path, _, _ in blocks for b, _, _ in lineage(host, path)}), np.int64)
            verdicts: dict[int, int] = {}
            for shard in held:
                own, bits = shard.value
                at, known = look_up(own, branches)
                verdicts.update(zip(branches[known].tolist(), bits[at[known]].tolist(), strict=True))
                if len(held) > 1:
                    del own, bits, shard._value
            texts = [_main_text(host, blocks, verdicts) for host, blocks in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [key, url, "text", "n_chars"])

    return map_batches(df.select(F.col(key).cast("long").alias(key), url, source), run, f"{key} long, {url} string, text string, n_chars long")
