from . import queries, detection, corpus, requests, joins, organizing, policies, learning  # noqa: F401, I001 - registers the queries
