"""Laid-out lines for tests, as a page reader would give them."""

SCHEMA = (
    "doc string, page int, seq int, text string, size double, bold boolean, block int, block_lines int, x0 double, y0 double, x1 double, y1 double, "
    "page_width double, page_height double, is_table boolean"
)


def lines(pages, doc="d", header=None, page_numbers=False):
    """One block per line at x = 72, each page a list of (text, size, bold)."""
    rows = []
    for number, page in enumerate(pages, start=1):
        placed = [(header, 8.0, False, 0, 72.0, 30.0)] if header else []
        y = 80.0
        for block, (text, size, bold) in enumerate(page, start=1):
            placed.append((text, float(size), bold, block, 72.0, y))
            y += 1.6 * size
        if page_numbers:
            placed.append((str(number), 8.0, False, 99, 290.0, 825.0))
        for seq, (text, size, bold, block, x, y) in enumerate(placed):
            rows.append((doc, number, seq, text, size, bold, block, 1, x, y, x + size * 0.5 * len(text), y + size * 1.2, 595.0, 842.0, False))
    return rows


def placed(pages, doc="d", blocks=None):
    """Each page a list of (x, y, text, size, bold); blocks gives each line's block, by default its own."""
    rows = []
    for number, page in enumerate(pages, start=1):
        for seq, (x, y, text, size, bold) in enumerate(page):
            block = blocks[seq] if blocks else seq
            n = blocks.count(block) if blocks else 1
            rows.append((doc, number, seq, text, float(size), bold, block, n, float(x), float(y), x + size * 0.5 * len(text), y + size * 1.2, 595.0, 842.0, False))
    return rows


def body(sentence, n=6):
    return [(f"{sentence} line {i}.", 11, False) for i in range(n)]


def book():
    pages = []
    for word, title in (("One", "The Start"), ("Two", "The Middle"), ("Three", "The End")):
        pages += [[(f"Chapter {word}: {title}", 20, True), *body(f"Story text {word}")], body(f"More text {word}")]
    return pages


def topics(n=5):
    pages = []
    for i in range(1, n + 1):
        domain = "Health Science" if i % 2 else "Technology"
        pages.append([(f"{i:03d}. Topic Title {i}", 18, True), (f"Domain: {domain} | Page 1 of 2", 11, False), *body(f"Mechanism number {i} uses gradient descent variant {chr(96 + i) * 3}", 4)])
        pages.append(body(f"Difficulty {i} is described as moderate", 4))
    return pages
