"""Text rules for large tables, as Spark expressions and jobs."""

from rulewright.errors import RuleError, SourceError
from rulewright.operators.paging import page_index, read_page
from rulewright.operators.profile import apply_rules, column_counts, profile
from rulewright.operators.results import count_matches, write_counted, write_result
from rulewright.operators.rulebook import catalogue_rules, known_rule, suggest_rules
from rulewright.operators.transform import RuleOutcome, apply_rule
from rulewright.plans.run import RuleSource, RunRequest, run_request
from rulewright.rule import EXTRACT, MASK, OPERATIONS, REPLACE, VALIDATE, TextRule, rules_table
from rulewright.session import build_session
from rulewright.sources.files import list_files
from rulewright.sources.preview import preview, sample_values
from rulewright.sources.tables import read_table
from rulewright.streaming.rules import apply_rule_stream

__all__ = [
    "EXTRACT",
    "MASK",
    "OPERATIONS",
    "REPLACE",
    "VALIDATE",
    "RuleError",
    "RuleOutcome",
    "RuleSource",
    "RunRequest",
    "SourceError",
    "TextRule",
    "apply_rule",
    "apply_rule_stream",
    "apply_rules",
    "build_session",
    "catalogue_rules",
    "column_counts",
    "count_matches",
    "known_rule",
    "list_files",
    "page_index",
    "preview",
    "profile",
    "read_page",
    "read_table",
    "rules_table",
    "run_request",
    "sample_values",
    "suggest_rules",
    "write_counted",
    "write_result",
]
