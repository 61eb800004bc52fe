"""Words in use stay remembered when the memory of a tokenizer fills up."""

from hearsay.llm import packing


def test_words_in_use_are_learned_once():
    encoder, learned = packing.WordEncoder(packing.default_tokenizer(), remembered=40), []
    learn = encoder._learn
    encoder._learn = lambda stems: (learned.extend(stems), learn(stems))
    word = lambda k: "q" + "".join(chr(97 + int(d)) for d in str(k))
    texts = [f"Common words, come AGAIN! {word(10 * i)} {' '.join(word(10 * i + j) for j in range(1, 9))} {i}.5 café; x..,".encode() for i in range(30)]
    for text in texts:
        ids = encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        assert encoder([text]) == [b"".join(i.to_bytes(4, "little") for i in ids)]
    assert learned.count(b"common") == learned.count(b"again") == 1
    assert max(map(len, (encoder.words, encoder.past_words, encoder.stems, encoder.past_stems))) <= 20 + 20


def test_words_of_a_text_are_no_python_objects_and_remembered_ones_are_small():
    import tracemalloc

    import pyarrow as pa

    encoder = packing.WordEncoder(packing.default_tokenizer())
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    new, often = [" ".join(word(i) for i in range(100_000, 140_000)).encode()], [b"Some words, of a text. " * 40_000]
    encoder(often)
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    encoder(new)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    assert held < 80 * 40_000
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    encoder(often)
    assert tracemalloc.get_traced_memory()[1] - before < 18 * len(often[0])
    tracemalloc.stop()


def test_capitals_before_combining_marks_and_in_added_tokens_count():
    encoder = packing.WordEncoder(packing.default_tokenizer())
    for text in ("J̌x. H̱a, T̈b; İc!", "<|ENDOFTEXT|>x, a<|endoftext|>B.", "A.b's IT'S.x don.'T !'s 'S.x x.1 1.x R.'re", ""):
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder([text.encode()]) == [b"".join(i.to_bytes(4, "little") for i in ids)]
