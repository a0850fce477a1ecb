"""Training-data operators over document tables (``doc_id``, ``text``, ...)."""
