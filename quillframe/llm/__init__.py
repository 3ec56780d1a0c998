"""Operations for preparing language-model training data.

Nothing else in the library imports this subpackage; deleting it (and
``corpus_pipeline.py``) leaves the rest working.
"""
