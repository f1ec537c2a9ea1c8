"""Training-data operators: extraction, language, URLs, joins, pieces, private data.

Nothing outside this subpackage imports it.  Each module is one operator with a
general interface; ``queries`` binds them to the tables of the test data.
"""
