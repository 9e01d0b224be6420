"""Where the public tokenizer files are; every operator takes the path as a parameter."""


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
