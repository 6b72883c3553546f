"""Results as SQL views."""

import pytest

from siteloom.views import register_views


def test_views_join_in_sql(spark, folder):
    assert register_views(spark, folder, ["page_titles", "page_paths"], "v_") == ["v_page_titles", "v_page_paths"]
    both = spark.sql("SELECT count(*) AS n FROM v_page_titles t JOIN v_page_paths p ON t.page_id = p.page_id").first().n
    assert both == spark.table("v_page_titles").count() > 0


def test_unknown_views_are_an_error(spark, folder):
    with pytest.raises(KeyError):
        register_views(spark, folder, ["no such query"])
