"""Where the public tokenizers' vocabulary files lie; a parameter everywhere, never copied."""

from __future__ import annotations

import os


def vocab_path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
