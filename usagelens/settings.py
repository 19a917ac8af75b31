"""Report settings.

Staff lists, id corrections and profile names of one organisation have no defaults: whoever runs
the report passes them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from usagelens.functions.rules import DefaultRule

# Profile, role and product names that the KPI definitions are written in.
BASE_PROFILES = ("Salesforce Base", "Advising Base", "Service Desk Base")
ADMIN_PROFILE = "System Administrator"
MATRIX_PRODUCTS = ("Service Desk", "Marketing - SF", "Scheduling/Notes", "MC", "Social", "Events")
MARKETING_LABEL = "MC"
SOCIAL_LABEL = "Social"
DEFAULT_RULES = (
    DefaultRule("role_name", ("Data Analyst",), "Reports"),
    DefaultRule("role_name", ("SAFER Volunteer", "SAFER"), "SAFER"),
    DefaultRule("profile_name", ("Advising Base",), "Scheduling/Notes"),
    DefaultRule("profile_name", ("Service Desk Base",), "Service Desk"),
    DefaultRule("role_name", ("Marketer",), "Marketing - SF"),
)


@dataclass(frozen=True)
class KpiSettings:
    """``excluded_profiles`` (of the entitlement base), ``excluded_net_ids`` (staff) and ``net_id_overrides``
    (id corrections) are the organisation's own; the first has to be stated."""

    excluded_profiles: tuple[str, ...]
    base_profiles: tuple[str, ...] = BASE_PROFILES
    admin_profile: str = ADMIN_PROFILE
    excluded_net_ids: tuple[str, ...] = ()
    excluded_user_keys: tuple[str, ...] = ()
    net_id_overrides: Mapping[str, str] = field(default_factory=dict)
    matrix_products: tuple[str, ...] = MATRIX_PRODUCTS
    default_rules: tuple[DefaultRule, ...] = DEFAULT_RULES
