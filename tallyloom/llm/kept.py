"""Objects that live as long as a Python worker, such as a loaded tokenizer.

Functions reach the workers by value and carry fresh globals into each task, so
what should outlive a task is kept in a module of the worker's interpreter.
"""

import sys
import types

_NAME = "tallyloom_llm_kept"


def kept(key, make):
    """The worker's object of this key, made on first use."""
    store = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
