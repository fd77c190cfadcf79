"""What the encoder remembers of the words of long runs."""

from kerbline.llm import sentencepiece_codec as codec


def test_many_distinct_words_are_encoded_once():
    model = codec.Codec(codec.codec_path())
    calls, encode = [0], model.encode_chunk

    def counted(chunk):
        calls[0] += 1
        return encode(chunk)

    model.encode_chunk = counted
    words = " ".join(f"w{i}" for i in range(120_000))
    assert model.encoded(words) == model.encoded(words)
    assert calls[0] == 120_000 + 1  # the line feed
