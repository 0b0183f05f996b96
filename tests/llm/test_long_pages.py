import tracemalloc

import numpy as np

from strataforge.llm import html_extraction as html

SENTENCE = "A long sentence of the article, with words."


def test_slices_give_what_one_piece_gives(monkeypatch):
    rng = np.random.default_rng(4)
    net = html.labeller()
    pages = [html.blocks(html.make_page(rng)) for _ in range(12)]
    whole = net.probabilities([html.vectors(p) for p in pages])
    for size in (1, 3, 7, 1000):
        monkeypatch.setattr(html, "SLICE", size)
        for p, prob in zip(pages, whole, strict=True):
            if p:
                assert np.allclose(net.of_long(p), prob, atol=1e-9)
    sources = [html.make_page(rng) for _ in range(6)]
    monkeypatch.setattr(html, "SLICE", 5)
    sliced = html.extract_text(sources, net)
    monkeypatch.setattr(html, "SLICE", 4096)
    assert sliced == html.extract_text(sources, net)


def test_memory_of_a_long_page_is_that_of_its_text():
    net, n = html.labeller(), 30_000
    page = "<body><nav><a href=x>Home</a></nav><article>" + f"<p>{SENTENCE}</p>" * n + "</article></body>"
    tracemalloc.start()
    (text,) = html.extract_text([page], net)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.count(SENTENCE) >= n - 1
    assert peak < 1500 * n  # bytes a block; some 6700 when all vectors were held
