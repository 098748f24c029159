"""Relational operators over candidates, histories, articles and vectors.

Normal form: an impression is named by the columns ``keys``. ``candidates`` has ``keys, pos, article_id`` and, where labels
are known, ``y``; ``history`` has ``keys, age, article_id`` with age 0 for the newest click. Arrays are for
the edges only. A ranker returns ``keys, pos, article_id, score``.
"""
