"""Custom (non-HTML) tags and their content behind numbered placeholders, and back."""

from __future__ import annotations

import re

# The element names of HTML.
HTML = frozenset(
    "html base head link meta style title body address article aside footer h1 h2 h3 h4 h5 h6 header hgroup main nav section search blockquote dd div dl dt figcaption figure hr li menu ol p pre ul a abbr b bdi bdo br cite code data dfn em i kbd "
    "mark q rp rt ruby s samp small span strong sub sup time u var wbr area audio img map track video embed iframe object param picture portal source svg math canvas noscript script del ins caption col colgroup table tbody td tfoot th thead tr "
    "button datalist fieldset form input label legend meter optgroup option output progress select textarea details dialog summary slot template".split()
)
TAG = re.compile(r"<(/?)([a-zA-Z_][\w\-.:]*)((?:\s+[^>]*?)?)(/?)>", re.A)


def spans(text: str) -> list[tuple[int, int]]:
    """Outermost stretches of custom tags: an element from its opening to its closing tag, or one self-closing tag."""
    found: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    at = 0
    while (m := TAG.search(text, at)) is not None:
        at = m.end()
        name = m[2].lower()
        if name in HTML:
            continue
        if m[1]:
            k = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == name), None)
            if k is not None:
                start = opened[k][1]
                found = [s for s in found if s[0] < start] + [(start, at)]
                del opened[k:]
        elif m[4]:
            found.append((m.start(), at))
        else:
            opened.append((name, m.start()))
    return found


def protect(text: str, prefix: str = "{{TAG_", suffix: str = "}}") -> tuple[str, dict[str, str]]:
    """(text with placeholders, placeholder to original); the prefix is salted where the text holds it already."""
    mark = prefix
    for salt in range(16):
        if mark not in text:
            break
        mark = f"{prefix}{salt}_"
    out, names, at = [], {}, 0
    for start, end in spans(text):
        if start < at:
            continue
        name = f"{mark}{len(names)}{suffix}"
        names[name] = text[start:end]
        out += [text[at:start], name]
        at = end
    return "".join([*out, text[at:]]), names


def restore(text: str, names: dict[str, str]) -> str:
    for name, original in names.items():
        text = text.replace(name, original, 1)
    return text
