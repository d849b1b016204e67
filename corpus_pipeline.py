"""The corpus pipeline by the names that callers use; its stages are in ``codeloom.llm.pipeline``."""

from codeloom.llm.pipeline import ORACLE_SQL, STAGES, language_id, mask_pii, mix_sources, near_dedup, pack, run  # noqa: F401
