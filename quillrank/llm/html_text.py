"""Main-text extraction: flat blocks with their neighbours' figures, and a decision tree.

A page is cut into text blocks at block-level tags. Each block has its word count and
link density, those of the blocks before and after it, how many linked blocks stand in a
row, whether it is a heading, begins like a copyright line or stands in a main container,
and what the containers around it are called: by tag (menus, footers, asides), plainly by
name (a class or id such as "sidebar" or "comment-list"), by place ("left"), or only in
passing ("no-sidebar", "search-results"). A called container has figures too: its share of
the page's running text, and how much of that text stands in no such container. Nothing
is decided by a name alone; a small tree, trained on the labelled table below when a task
starts, weighs names and figures. So a container that holds the text of the page stays,
whatever it is called, and one called plainly goes when the text is elsewhere.

Scripts, styles, comments and other markup never make blocks; a tag cut off by the end
of the page is markup too. Null html counts as empty and gives an empty text; null ids
and urls stay null; repeated rows are extracted alike; a tie in a leaf counts as main
text; a page, however long, is handled in one task, in memory proportional to it; other
columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import arrow_limits

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select option button head".split())
# What these tags hold is text up to their end tag, whatever it looks like.
VERBATIM = ("script", "style", "textarea", "title")
# What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AWAY_TAGS = frozenset("nav footer aside menu dialog".split())
# Tags that may hold all of a page as well.
LOOSE_TAGS = frozenset("form fieldset header".split())
MAIN_TAGS = frozenset("article main".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright discussion disqus feedback footer form header legal login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets alert consent gdpr disclaimer".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
PLACE_WORDS = frozenset("left right side rail secondary tertiary".split())
# What a name says in passing, before or after a word of the list: "no-sidebar", "search-results".
PASSING_FIRST = frozenset("no has with without is not hide show js".split())
PASSING_LAST = frozenset("page results result open opened closed fixed enabled disabled accepted active inactive visible hidden loaded layout template theme mode style".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(/?>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(>|\Z)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}\s*>|</{t}\s*\Z", re.I) for t in VERBATIM}

# What an article or main element is named when it is no main text after all.
NOT_MAIN_WORDS = frozenset("ad ads advert advertisement comment comments promo promoted related reply replies sponsored teaser widget".split())
# How a copyright line begins.
NOTICE = re.compile(r"(©|\(c\)\s|copyright\s+(©|\(c\)|(19|20)\d\d\b)|all rights reserved)", re.I)
#: What containers are called: nothing, in passing, by place, plainly, by tag.
NOTHING, PASSING, PLACE, PLAIN, BY_TAG = range(5)
#: A block of as many words, most of them in no link, is running text.
TEXT_WORDS = 5
#: What an article element adds to the running text that it is weighed as.
ARTICLE_WORDS = 1000

#: Columns: words, link density, words before, link density before, words after, link density after,
#: main container (1 by name, 2 by tag) or none (0), heading (2 for the first level); then whether the block is main text.
#: Nothing calls the containers of these blocks, and no linked blocks stand in a row but those beside linked ones.
PLAIN_BLOCKS = (
    # Inside a main container: headings, paragraphs of any length, items, bylines, closing lines.
    (8, 0.0, 0, 0.0, 60, 0.0, 1, 1, 1), (3, 0.0, 60, 0.0, 12, 0.0, 1, 1, 1), (4, 0.0, 30, 0.0, 2, 1.0, 1, 1, 1), (7, 0.0, 3, 1.0, 2, 1.0, 1, 1, 1),
    (90, 0.0, 8, 0.0, 70, 0.0, 1, 0, 1), (300, 0.0, 3, 0.0, 0, 0.0, 1, 0, 1), (2, 0.0, 60, 0.0, 80, 0.0, 1, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1),
    (5, 0.0, 9, 0.0, 0, 0.0, 1, 0, 1), (1, 0.0, 9, 0.0, 12, 0.0, 1, 0, 1), (6, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (6, 0.0, 4, 1.0, 5, 1.0, 1, 0, 1),
    (30, 0.2, 50, 0.0, 40, 0.1, 1, 0, 1), (12, 0.4, 50, 0.0, 60, 0.0, 1, 0, 1), (40, 0.6, 50, 0.0, 60, 0.0, 1, 0, 1), (20, 0.5, 70, 0.0, 0, 0.0, 1, 0, 1),
    (15, 0.3, 60, 0.1, 0, 0.0, 1, 0, 1), (9, 0.7, 50, 0.0, 3, 1.0, 1, 0, 1), (10, 0.8, 40, 0.0, 30, 0.0, 1, 0, 1), (25, 0.8, 3, 1.0, 40, 0.0, 1, 0, 1),
    (2, 1.0, 8, 0.0, 90, 0.0, 1, 0, 1), (6, 1.0, 60, 0.0, 50, 0.0, 1, 0, 1), (9, 1.0, 40, 0.1, 30, 0.0, 1, 0, 1), (12, 1.0, 80, 0.0, 0, 0.0, 1, 0, 1),
    (2, 0.0, 0, 0.0, 2, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 60, 0.0, 1, 0, 1), (2, 0.0, 0, 0.0, 40, 0.0, 1, 0, 1), (1, 0.0, 3, 1.0, 5, 0.0, 1, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (1, 0.0, 0, 0.0, 1, 0.0, 1, 0, 1), (2, 1.0, 2, 0.0, 90, 0.0, 1, 0, 1), (2, 1.0, 3, 0.0, 40, 0.0, 1, 0, 1),
    # Inside a main container: runs of links.
    (3, 1.0, 3, 1.0, 4, 1.0, 1, 0, 0), (2, 1.0, 60, 0.0, 3, 1.0, 1, 0, 0), (3, 1.0, 4, 1.0, 50, 0.0, 1, 0, 0), (5, 1.0, 5, 1.0, 0, 0.0, 1, 0, 0),
    (8, 1.0, 60, 0.0, 9, 1.0, 1, 0, 0), (4, 1.0, 8, 0.0, 5, 1.0, 1, 0, 0), (6, 1.0, 9, 1.0, 30, 0.1, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0),
    # Without a container: paragraphs, and what stands beside them.
    (90, 0.0, 8, 0.0, 70, 0.0, 0, 0, 1), (45, 0.1, 90, 0.0, 80, 0.0, 0, 0, 1), (300, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (60, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1),
    (35, 0.2, 6, 0.0, 2, 1.0, 0, 0, 1), (25, 0.0, 5, 0.0, 30, 0.0, 0, 0, 1), (28, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1), (20, 0.0, 40, 0.0, 55, 0.0, 0, 0, 1),
    (18, 0.0, 6, 0.0, 22, 0.1, 0, 0, 1), (12, 0.0, 25, 0.0, 30, 0.0, 0, 0, 1), (12, 0.4, 50, 0.0, 60, 0.0, 0, 0, 1), (40, 0.5, 50, 0.0, 60, 0.0, 0, 0, 1),
    (20, 0.5, 60, 0.0, 0, 0.0, 0, 0, 1), (8, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1), (4, 0.0, 30, 0.0, 45, 0.0, 0, 0, 1), (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1),
    (3, 0.0, 40, 0.0, 0, 0.0, 0, 0, 1), (9, 0.0, 50, 0.1, 0, 0.0, 0, 0, 1), (8, 0.0, 60, 0.0, 3, 1.0, 0, 0, 1), (5, 0.0, 45, 0.0, 1, 1.0, 0, 0, 1),
    (2, 0.0, 20, 0.0, 2, 0.0, 0, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 1), (3, 0.0, 3, 0.0, 40, 0.0, 0, 0, 1), (2, 0.0, 8, 0.0, 50, 0.0, 0, 0, 1),
    (3, 0.0, 40, 0.0, 1, 1.0, 0, 0, 1), (2, 0.0, 50, 0.0, 1, 1.0, 0, 0, 1), (3, 0.0, 70, 0.0, 4, 1.0, 0, 0, 1), (2, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1),
    (1, 0.0, 40, 0.0, 1, 0.0, 0, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 1), (1, 0.0, 1, 0.0, 40, 0.0, 0, 0, 1), (2, 0.0, 1, 0.0, 3, 0.0, 0, 0, 1),
    (40, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1), (12, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1), (60, 0.0, 0, 0.0, 4, 0.0, 0, 0, 1), (40, 0.0, 0, 0.0, 3, 1.0, 0, 0, 1),
    (60, 0.0, 0, 0.0, 5, 0.0, 1, 0, 1), (3, 0.0, 0, 0.0, 3, 0.0, 1, 0, 1), (4, 0.0, 0, 0.0, 2, 1.0, 1, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (1, 0.0, 9, 0.7, 0, 0.0, 1, 0, 1), (3, 0.0, 5, 1.0, 0, 0.0, 1, 0, 1), (4, 0.0, 8, 0.9, 1, 0.0, 1, 0, 1), (5, 0.0, 3, 1.0, 2, 0.0, 1, 0, 1),
    (5, 0.0, 15, 0.3, 2, 1.0, 0, 0, 1), (7, 0.0, 20, 0.2, 1, 1.0, 0, 0, 1), (4, 0.0, 30, 0.0, 2, 1.0, 0, 0, 1), (6, 0.0, 26, 0.0, 3, 1.0, 0, 0, 1),
    (3, 0.0, 18, 0.2, 1, 1.0, 0, 0, 1), (8, 0.0, 14, 0.3, 1, 1.0, 0, 0, 1), (5, 0.0, 25, 0.1, 2, 1.0, 0, 0, 1), (4, 0.0, 17, 0.3, 1, 1.0, 0, 0, 1),
    # Items of a list in plain text, between others of their kind.
    (4, 0.0, 5, 0.0, 6, 0.0, 0, 0, 1), (7, 0.0, 3, 0.0, 8, 0.0, 0, 0, 1), (3, 0.0, 7, 0.0, 3, 0.0, 0, 0, 1), (8, 0.0, 6, 0.0, 5, 0.0, 0, 0, 1), (10, 0.0, 9, 0.0, 9, 0.0, 0, 0, 1), (6, 0.0, 2, 0.0, 4, 0.0, 0, 0, 1),
    # A paragraph after links, with little or nothing after it.
    (60, 0.0, 1, 1.0, 0, 0.0, 0, 0, 1), (40, 0.0, 2, 1.0, 1, 0.0, 1, 0, 1), (30, 0.0, 3, 1.0, 2, 0.0, 0, 0, 1), (80, 0.0, 4, 1.0, 0, 0.0, 1, 0, 1),
    (25, 0.1, 2, 1.0, 0, 0.0, 0, 0, 1), (20, 0.0, 1, 1.0, 2, 0.0, 0, 0, 1), (6, 0.0, 2, 1.0, 0, 0.0, 1, 0, 1), (2, 0.0, 2, 1.0, 2, 0.0, 1, 0, 1),
    (3, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0), (4, 0.0, 5, 1.0, 1, 0.0, 0, 0, 0), (5, 0.0, 3, 1.0, 2, 0.0, 0, 0, 0), (1, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0),
    # Without a container: headings over text.
    (10, 0.0, 3, 1.0, 50, 0.0, 0, 1, 1), (6, 0.0, 40, 0.0, 60, 0.0, 0, 1, 1), (6, 0.0, 0, 0.0, 20, 0.0, 0, 1, 1), (5, 0.0, 1, 1.0, 12, 0.0, 0, 1, 1),
    (4, 0.0, 2, 1.0, 80, 0.0, 0, 1, 1), (5, 0.0, 1, 1.0, 50, 0.0, 0, 1, 1), (3, 0.0, 2, 1.0, 60, 0.0, 0, 1, 1), (4, 0.0, 2, 1.0, 30, 0.0, 1, 1, 1),
    (4, 0.0, 0, 0.0, 80, 0.0, 0, 1, 1), (3, 0.0, 0, 0.0, 50, 0.0, 0, 1, 1), (2, 0.0, 0, 0.0, 60, 0.0, 0, 1, 1), (4, 0.0, 0, 0.0, 30, 0.0, 0, 1, 1),
    # Without a container: menus, taglines, link lists and headings over them.
    (4, 1.0, 4, 1.0, 5, 1.0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (9, 0.8, 3, 1.0, 4, 1.0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0),
    (5, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (2, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0), (7, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0), (6, 0.5, 9, 0.0, 5, 0.6, 0, 0, 0),
    (4, 0.0, 6, 0.0, 5, 1.0, 0, 0, 0), (8, 0.0, 5, 1.0, 3, 1.0, 0, 0, 0), (15, 0.9, 40, 0.0, 30, 0.0, 0, 0, 0), (3, 1.0, 60, 0.0, 50, 0.0, 0, 0, 0),
    (3, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0), (4, 1.0, 5, 1.0, 0, 0.0, 0, 0, 0), (2, 0.0, 60, 0.0, 2, 1.0, 0, 1, 0), (3, 0.0, 4, 1.0, 3, 1.0, 0, 1, 0),
    (1, 0.0, 60, 0.0, 2, 1.0, 0, 1, 0), (1, 0.0, 40, 0.0, 1, 1.0, 0, 1, 0), (5, 0.0, 50, 0.0, 3, 1.0, 0, 1, 0), (4, 0.0, 30, 0.0, 4, 1.0, 0, 1, 0),
    (12, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0), (30, 0.9, 50, 0.0, 8, 1.0, 0, 0, 0), (2, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0), (9, 1.0, 2, 0.0, 40, 0.0, 0, 0, 0),
)
#: The same columns, then: what containers are called, their share of running text beside what stands elsewhere, words of the latter,
#: copyright line, outside a main container that holds the text, linked blocks in a row; then whether it is main text.
CALLED_BLOCKS = (
    # By tag: away, whatever else.
    (4, 1.0, 0, 0.0, 3, 1.0, 0, 0, 4, 0.0, 0, 0, 0, 6, 0), (30, 0.0, 60, 0.0, 0, 0.0, 0, 0, 4, 0.0, 0, 0, 0, 0, 0), (80, 0.0, 50, 0.0, 0, 0.0, 0, 0, 4, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 60, 0.0, 30, 0.0, 1, 1, 4, 0.0, 0, 0, 0, 0, 0),
    (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 4, 0.0, 0, 0, 0, 0, 0), (25, 0.1, 90, 0.0, 20, 0.0, 2, 0, 4, 0.0, 0, 0, 0, 0, 0), (12, 0.0, 5, 0.0, 8, 1.0, 0, 2, 4, 0.0, 0, 0, 0, 0, 0), (7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 4, 0.0, 0, 1, 0, 0, 0),
    # In passing: as if not called.
    (70, 0.0, 8, 0.0, 60, 0.0, 0, 0, 1, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 0, 0.0, 60, 0.0, 0, 2, 1, 0.0, 0, 0, 0, 0, 1), (3, 1.0, 3, 1.0, 2, 1.0, 0, 0, 1, 0.0, 0, 0, 0, 6, 0), (45, 0.1, 60, 0.0, 0, 0.0, 1, 0, 1, 0.0, 0, 0, 0, 0, 1),
    # Outside the main container that holds the text: away, but for the title.
    (25, 0.0, 0, 0.0, 8, 0.0, 0, 0, 0, 0.0, 0, 0, 1, 0, 0), (60, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0.0, 0, 0, 1, 0, 0), (12, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0.0, 0, 0, 1, 0, 0), (4, 0.0, 3, 1.0, 50, 0.0, 0, 0, 0, 0.0, 0, 0, 1, 0, 0),
    (3, 0.0, 40, 0.0, 20, 0.0, 0, 1, 0, 0.0, 0, 0, 1, 0, 0), (90, 0.0, 70, 0.0, 0, 0.0, 0, 0, 1, 0.0, 0, 0, 1, 0, 0), (2, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0.0, 0, 0, 1, 0, 0), (40, 0.1, 50, 0.0, 60, 0.0, 0, 0, 0, 0.0, 0, 0, 1, 0, 0),
    (8, 0.0, 2, 1.0, 50, 0.0, 0, 2, 0, 0.0, 0, 0, 1, 0, 1), (5, 0.0, 0, 0.0, 30, 0.0, 0, 2, 0, 0.0, 0, 0, 1, 0, 1), (11, 0.0, 3, 1.0, 70, 0.0, 0, 2, 0, 0.0, 0, 0, 1, 0, 1), (6, 0.0, 9, 0.0, 12, 0.0, 0, 2, 1, 0.0, 0, 0, 1, 0, 1),
    # Copyright lines outside a main container.
    (3, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0.0, 0, 1, 0, 0, 0), (8, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0.0, 0, 1, 0, 0, 0), (20, 0.1, 40, 0.0, 0, 0.0, 0, 0, 0, 0.0, 0, 1, 0, 0, 0), (35, 0.0, 50, 0.0, 6, 0.0, 0, 0, 0, 0.0, 0, 1, 0, 0, 0),
    (6, 0.0, 50, 0.0, 0, 0.0, 1, 0, 0, 0.0, 0, 1, 0, 0, 1), (30, 0.0, 50, 0.0, 40, 0.0, 2, 0, 0, 0.0, 0, 1, 0, 0, 1),
    # Inside an article element: a few links are part of it, a row of many is a menu.
    (2, 1.0, 60, 0.0, 2, 1.0, 2, 0, 0, 0.0, 0, 0, 0, 2, 1), (2, 1.0, 2, 1.0, 40, 0.0, 2, 0, 0, 0.0, 0, 0, 0, 2, 1), (3, 1.0, 3, 1.0, 0, 0.0, 2, 0, 0, 0.0, 0, 0, 0, 2, 1), (4, 1.0, 5, 1.0, 3, 1.0, 2, 0, 0, 0.0, 0, 0, 0, 3, 1),
    (1, 1.0, 50, 0.0, 1, 1.0, 2, 0, 0, 0.0, 0, 0, 0, 3, 1), (3, 1.0, 3, 1.0, 4, 1.0, 2, 0, 0, 0.0, 0, 0, 0, 6, 0), (2, 1.0, 60, 0.0, 3, 1.0, 2, 0, 0, 0.0, 0, 0, 0, 5, 0), (5, 1.0, 4, 1.0, 0, 0.0, 2, 0, 0, 0.0, 0, 0, 0, 8, 0),
    # All there is on a page.
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 2, 0, 0.0, 0, 0, 0, 0, 1),
)


def _with_row(row: tuple) -> tuple:
    """A plain block with the columns of called ones: four linked blocks in a row if it stands beside linked ones."""
    linked = row[1] >= 0.8
    return (*row[:8], NOTHING, 0.0, 0, 0, 0, linked * (4 if row[3] >= 0.8 or row[5] >= 0.8 else 1), row[8])


# Blocks of any shape in containers called plainly or by place: the figures decide. First the columns up to the heading.
SHAPES = (
    (70, 0.0, 8, 0.0, 60, 0.0, 0, 0), (6, 0.0, 0, 0.0, 60, 0.0, 0, 2), (5, 0.0, 50, 0.0, 30, 0.0, 1, 1), (4, 0.0, 60, 0.0, 0, 0.0, 0, 0),
    (30, 0.2, 3, 1.0, 14, 0.0, 1, 0), (12, 0.0, 1, 1.0, 11, 0.0, 0, 0), (40, 0.0, 5, 0.0, 0, 0.0, 2, 0), (1, 0.0, 0, 0.0, 9, 0.0, 0, 1),
)
#: What containers are called, share of running text, running text elsewhere; then whether its blocks are main text.
FIGURES = (
    (PLAIN, 0.0, 5, 0), (PLAIN, 0.0, 20, 0), (PLAIN, 0.2, 10, 0), (PLAIN, 0.25, 25, 0), (PLAIN, 0.4, 15, 0), (PLAIN, 0.45, 40, 0), (PLAIN, 0.55, 8, 0),
    (PLAIN, 0.0, 60, 0), (PLAIN, 0.1, 30, 0), (PLAIN, 0.1, 300, 0), (PLAIN, 0.3, 90, 0), (PLAIN, 0.5, 100, 0), (PLAIN, 0.55, 25, 0), (PLAIN, 0.7, 70, 0), (PLAIN, 0.8, 60, 0), (PLAIN, 0.0, 1000, 0), (PLAIN, 0.1, 1100, 0), (PLAIN, 0.4, 1300, 0),
    (PLAIN, 0.7, 40, 1), (PLAIN, 0.8, 20, 1), (PLAIN, 0.95, 8, 1), (PLAIN, 1.0, 0, 1), (PLAIN, 0.95, 40, 1),
    (PLACE, 0.0, 60, 0), (PLACE, 0.1, 80, 0), (PLACE, 0.2, 40, 0), (PLACE, 0.3, 300, 0), (PLACE, 0.0, 1000, 0), (PLACE, 0.2, 1200, 0), (PLACE, 0.45, 100, 1), (PLACE, 0.6, 80, 1), (PLACE, 0.9, 20, 1), (PLACE, 1.0, 0, 1),
)
LABELLED = tuple(map(_with_row, PLAIN_BLOCKS)) + CALLED_BLOCKS + tuple((*shape, called, share, elsewhere, 0, 0, 0, label) for shape in SHAPES for called, share, elsewhere, label in FIGURES)


def grow(rows: np.ndarray, depth: int = 20, least: int = 1):
    """A CART tree by Gini impurity: (column, limit, below or equal, above), or the share of label 1 at a leaf."""
    x, y = rows[:, :-1], rows[:, -1]
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = None
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, c] <= limit
            n = low.sum()
            if least <= n <= len(y) - least:
                p, q = y[low].mean(), y[~low].mean()
                cost = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, c, float(limit), low)
    if best is None:
        return float(y.mean())
    _, c, limit, low = best
    return c, limit, grow(rows[low], depth - 1, least), grow(rows[~low], depth - 1, least)


def decide(tree, row: tuple) -> bool:
    while isinstance(tree, tuple):
        column, limit, below, above = tree
        tree = below if row[column] <= limit else above
    return tree >= 0.5


def _called(token: str) -> int:
    """What one class, id or role says."""
    words = _WORDS.findall(token)
    if not words:
        return NOTHING
    if AWAY_WORDS.isdisjoint(words):
        return PLACE if PLACE_WORDS & set(words) and not MAIN_WORDS & set(words) else NOTHING
    if len(words) > 1 and (words[0] in PASSING_FIRST or words[-1] in PASSING_LAST):
        return PASSING
    # The head of an article is part of it.
    return PASSING if AWAY_WORDS & set(words) == {"header"} and MAIN_WORDS & set(words) else PLAIN


def _says(tag: str, attributes: str, inside_main: bool) -> tuple[int, int]:
    """Whether a container is a main one (1 by name, 2 by tag), and what it is called."""
    tokens = [t for m in _NAMED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split()]
    called = max(map(_called, tokens), default=NOTHING)
    words = {w for t in tokens for w in _WORDS.findall(t)}
    if tag in AWAY_TAGS:
        return 0, BY_TAG
    if tag in LOOSE_TAGS:
        return 0, NOTHING if tag == "header" and inside_main else PLAIN
    if tag in MAIN_TAGS:
        return (0, PLAIN) if called == PLAIN and words & NOT_MAIN_WORDS else (2, NOTHING)
    if tag in ("body", "html"):
        return 0, NOTHING
    if called == PLAIN and inside_main and words & AWAY_WORDS == {"header"}:
        called = PASSING
    return int(bool(words & MAIN_WORDS) and tag in ("div", "section", "td")), called


#: text, words, words in links, main container, heading, what containers are called, and which of them it is.
Block = tuple[str, int, int, int, int, int, int]


def blocks(page: str) -> list[Block]:
    """Every block with words, in page order."""
    out: list[Block] = []
    outside = (0, NOTHING, 0)
    # Open block-level and hidden tags, and inside each: main container, what is called the strongest, the number of that container.
    stack: list[tuple[str, tuple[int, int, int]]] = []
    containers = 0
    parts: list[str] = []
    links = hidden = heading = 0
    link_words = 0
    at, n = 0, len(page)

    def close() -> None:
        nonlocal parts, link_words
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                main, called, which = stack[-1][1] if stack else outside
                out.append((" ".join(words), len(words), min(link_words, len(words)), main, heading, called, which))
        parts, link_words = [], 0

    def end(tag: str) -> None:
        """Close the innermost open ``tag`` and whatever was left open in it."""
        nonlocal hidden
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                hidden -= sum(t in RAW for t, _ in stack[k:])
                del stack[k:]
                break

    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if hidden and stack[-1][0] == "head" and page[at:stop].strip():
            end("head")
        if stop > at and not hidden:
            text = page[at:stop]
            parts.append(text)
            if links:
                link_words += len(text.split())
        if not m:
            break
        at = m.end()
        name = m[2] or m[6]
        if not name:
            if m[0].startswith("<![CDATA[") and not hidden:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, attributes = name.lower(), m[3] or m[7] or ""
        ending = bool(m[1] or m[5])
        alone = tag in VOID or (m[4] or m[8]) == "/>"
        if hidden and not ending and stack[-1][0] == "head" and tag not in IN_HEAD:
            end("head")
        if tag == "a":
            links = 0 if ending else 1
            continue
        if tag in INLINE:
            continue
        if tag in RAW:
            if not ending and tag in _END:
                found = _END[tag].search(page, at)
                at = found.end() if found else n
            close()
            if ending:
                end(tag)
            elif not alone and tag not in _END:
                if tag in ("button", "select") or tag == "option" and stack and stack[-1][0] == "option":
                    end(tag)
                stack.append((tag, stack[-1][1] if stack else outside))
                hidden += 1
            continue
        if tag == "body":
            stack[:] = [x for x in stack if x[0] not in RAW]
            hidden = 0
        close()
        if tag in HEADINGS:
            heading = 0 if ending else 1 + (tag == "h1")
        if alone:
            continue
        links = 0
        if not ending:
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            above, strongest, which = stack[-1][1] if stack else outside
            main, called = _says(tag, attributes, above > 0 and strongest < PLACE)
            if tag in MAIN_TAGS and main and any(t == "form" for t, _ in stack) and all(x[1][1] < PLAIN or x[0] == "form" for x in stack if x[1][2] != which or x[0] == "form"):
                strongest = NOTHING  # a page that is one form has its text in an element of its own
            if called > strongest:
                containers += 1
                strongest, which = called, containers
            stack.append((tag, (max(above, main), strongest, which)))
        else:
            end(tag)
    close()
    return out


def rows_of(found: list[Block]) -> list[tuple]:
    """The tree's columns for each block."""
    n = len(found)
    figures = [(0, 0.0), *((b[1], round(b[2] / b[1], 3)) for b in found), (0, 0.0)]
    text = [b[1] - b[2] if b[1] >= TEXT_WORDS and 2 * b[2] < b[1] else 0 for b in found]
    # Running text by container, in those that nothing calls away, and in main ones of these.
    inside: dict[int, int] = {}
    for b, words in zip(found, text, strict=True):
        if b[5] >= PLACE:
            inside[b[6]] = inside.get(b[6], 0) + words
    free = [words for b, words in zip(found, text, strict=True) if b[5] < PLAIN]
    rest, main = sum(free), sum(words for b, words in zip(found, text, strict=True) if b[5] < PLACE and b[3])
    runs = [0] * n
    k = 0
    while k < n:
        j = k
        while j < n and figures[j + 1][1] >= 0.8:
            j += 1
        runs[k:j] = [j - k] * (j - k)
        k = max(j, k + 1)
    # An article element outside such containers is the text, however short.
    tagged = any(b[3] == 2 and b[5] < PLACE for b in found)
    out = []
    for k, b in enumerate(found):
        called = b[5] in (PLACE, PLAIN)
        own = inside[b[6]] if called else 0
        elsewhere = (rest - (own if b[5] < PLAIN else 0)) + tagged * ARTICLE_WORDS if called else 0
        beside = not b[3] and not called and 5 * main >= 3 * rest > 0
        share = round(own / max(1, own + elsewhere), 3)
        out.append((*figures[k + 1], *figures[k], *figures[k + 2], b[3], b[4], b[5], share, elsewhere, int(bool(NOTICE.match(b[0]))), int(beside), runs[k]))
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return " ".join(b[0] for b, row in zip(found, rows_of(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    arrow_limits(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = grow(np.array(LABELLED, float))
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
