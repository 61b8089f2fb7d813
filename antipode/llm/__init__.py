"""Training-data operators: duplicates, mixing, packing, fingerprints, language, page text.

Nothing outside this package imports it. The registered queries are in
``antipode.llm.queries``; the pipeline over them is ``corpus_pipeline.py``.
"""
