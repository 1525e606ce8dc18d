"""Token counters against the library, for vocabularies that ranks by id would count wrongly."""

from __future__ import annotations

import json

import pytest
from tokenizers import Tokenizer

from marginalia.llm.token_counts import _byte_of_character, _ids_follow_merges, counter


def spec(merges, order):
    """A byte-level vocabulary whose merged tokens get their ids in the given order."""
    singles = list(_byte_of_character())
    vocab = {t: i for i, t in enumerate(singles)} | {t: len(singles) + i for i, t in enumerate(order)}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "vocab": vocab, "merges": merges}
    return {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": None, "model": model}


@pytest.mark.parametrize(
    ("merges", "order", "by_id"),
    [
        (["a b", "b c", "bc d"], ["ab", "bc", "bcd"], True),
        (["a b", "b c", "bc d"], ["bc", "bcd", "ab"], False),  # the ids are in another order
        (["a b"], ["ab", "cd"], False),  # a token that no merge makes
        ([["a", "b"], ["b", "c"], ["bc", "d"]], ["ab", "bc", "bcd"], True),
    ],
)
def test_counts_equal_the_library(merges, order, by_id):
    made = spec(merges, order)
    content = json.dumps(made).encode()
    assert _ids_follow_merges(made["model"]) == by_id
    texts = ["abcd", "abcd bcd ab", "cdcd", "", "é abcdabcd"]
    library = Tokenizer.from_str(content.decode())
    assert counter(content, "x.json")(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
