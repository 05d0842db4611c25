"""Patterns and word lists whose meaning the results depend on. Java syntax; white space is the set ECMAScript calls \\s."""

SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)

#: ASCII word boundaries.
B0, B1 = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"

NUMBERED_LINE = rf"^{SPACE}*[0-9]+[.)]{SPACE}+{NOT_SPACE}"
ORDERED_ITEM = rf"^[0-9]+[.)]{SPACE}+(.*)\z"
UNORDERED_ITEM = rf"^[-*]{SPACE}+(.*)\z"
HEADING = rf"^(#{{1,6}}){SPACE}+(.*)\z"
CHAPTER = rf"(?i)^chapter{SPACE}+([0-9]+){SPACE}*[:.\-–]?{SPACE}*(.*)\z"
BONUS = rf"(?i)^bonus(?![A-Za-z0-9_]){SPACE}*[:.\-–]?{SPACE}*(.*)\z"
CALLOUT = r'(?i)^[^a-z0-9]*callout[^a-z0-9]*kind[^a-z0-9"]*([a-z]+),\s*eyebrow[^a-z0-9"]*"([^"]+)",\s*body[^a-z0-9"]*"([^"]+)"\s*\}\]:?\s*\z'
#: End of a block while lines are joined, and end of a paragraph in an audit: two sets, on purpose.
ENDS_BLOCK = r"[.!?:;\"'’”)\]]\z"
ENDS_SENTENCE = r"[.!?][\"')\]]?\z"
ENDS_SOFTLY = r"[:;,\"'’”)\]]\z"
CONTINUES = r"^[•\-*]|^[a-z]"
C1 = r"[\x{80}-\x{9F}]"
CID = r"\(cid:[0-9]+\)"
WARNING = r"(?i)^(warning|caution|never|important)(?![A-Za-z0-9_])"
CHECK = r"(?i)^(check|verify|confirm|ensure|make sure|double-check|review that|test that)(?![A-Za-z0-9_])"
CALCULATION = r"=.*[-+*/%]|[-+*/%].*="
ORDINAL = rf"(?i){B0}(first|second|third|fourth|fifth|next|then|last|finally|afterwards?|before that|to begin|to start){B1}"
ORDER_MATTERS = rf"(?i){B0}(that|this){SPACE}+(order|sequence){SPACE}+matters?{B1}|{B0}in{SPACE}+(that|this){SPACE}+order{B1}|{B0}order{SPACE}+matters?{B1}"
PROMISE = (
    rf"(?i){B0}(do(e?s)?{SPACE}+and{SPACE}+(don'?ts?|do{SPACE}*nots?)|pros{SPACE}+and{SPACE}+cons|before{SPACE}+and{SPACE}+after|dos?{SPACE}*/{SPACE}*don'?ts?){B1}"
    rf"|^{SPACE}*[0-9]+{SPACE}+(ways?|steps?|rules?|reasons?|things?|mistakes?){B1}|{B0}the{SPACE}+[0-9]+{SPACE}+(ways?|steps?|rules?|reasons?|checks?){B1}|{B0}vs\.?{B1}|{B0}versus{B1}"
)
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'-]*"
REFERENCE = r"""(?:src|href)="([^"]+)"|url\(([^)]+)\)"""
FONT_URL = r"""(?i)url\((["']?)((?:(?!\1)[^)])+\.(?:ttf|otf|woff2?))\1\)"""
RASTER = r"""(?i)src="([^"]+\.(?:png|jpe?g))\""""
ELEMENT_ID = rf'{SPACE}id="([^"]+)"'
TOC_ENTRY = r'(?s)<li class="toc-entry">.*?<a href="#([^"]+)".*?<span class="toc-pagenum" data-target="#([^"]+)">'
FIELD = rf"^\*\*([^*:]+):\*\*{SPACE}*(.*)\z"
ROMAN, ARABIC = r"(?i)^[ivxlcdm]+\z", r"^[0-9]+\z"
#: Hyphens that a renderer puts in, and the one that authors write.
RENDERER_HYPHENS, AUTHORED_HYPHEN = ["‐", "‑", "­"], "-"

#: Labels of the brand form and the fields they fill.
FIELDS = {
    "niche": "niche",
    "book title": "title",
    "subtitle": "subtitle",
    "author / brand name": "author",
    "target reader": "targetReader",
    "tone": "tone",
    "disclaimer": "disclaimer",
    "primary": "primary",
    "secondary": "secondary",
    "accent": "accent",
    "background": "background",
    "text": "text",
    "background alt": "backgroundAlt",
    "text muted": "textMuted",
    "heading": "headingColor",
    "border": "border",
    "rule": "rule",
    "link": "link",
    "danger": "danger",
    "cta title": "ctaTitle",
    "cta body": "ctaContent",
    "cta link": "ctaLink",
    "cta link label": "ctaLinkLabel",
    "back cover punchline": "backCoverPunchline",
    "back cover bullets": "backCoverBullets",
    "body font": "fontBody",
    "heading font": "fontHeading",
    "mono font": "fontMono",
}
REQUIRED_FIELDS = ["niche", "title", "author", "targetReader", "tone", "primary", "secondary", "accent", "background", "text"]
#: Style variables of the palette's keys.
PALETTE_VARIABLES = {
    "bg": "color-bg",
    "bgAlt": "color-bg-alt",
    "text": "color-text",
    "textMuted": "color-text-muted",
    "heading": "color-heading",
    "primary": "color-primary",
    "secondary": "color-secondary",
    "accent": "color-accent",
    "border": "color-border",
    "rule": "color-rule",
    "link": "color-link",
    "danger": "color-danger",
}
