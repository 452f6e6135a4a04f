"""Registered queries; importing a module registers its queries."""

import scriptorium.plans.aggregate_queries  # noqa: F401
import scriptorium.plans.graph_queries  # noqa: F401
import scriptorium.plans.listing_queries  # noqa: F401
import scriptorium.plans.markup_queries  # noqa: F401
import scriptorium.plans.row_queries  # noqa: F401
import scriptorium.plans.text_queries  # noqa: F401
