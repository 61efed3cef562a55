import os

import pytest

from tidemark.llm import tokens


@pytest.fixture(scope="session")
def enc():
    if not os.path.exists(f"{tokens.FOLDER}/{tokens.VOCABULARY}.tiktoken"):
        pytest.skip("no vocabulary files")
    return tokens.encoding()
