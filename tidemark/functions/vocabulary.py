"""The registered features of posts and preferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys and labels of each group.
FEATURES: dict[str, dict[str, str]] = {
    "region": {"seoul": "서울", "busan": "부산", "jeju": "제주", "gangwon": "강원", "gyeongju": "경주"},
    "theme": {"cafe": "카페", "food": "맛집", "nature": "자연", "night_view": "야경", "culture": "문화", "shopping": "쇼핑", "healing": "힐링"},
    "pace": {"relaxed": "느긋함", "balanced": "균형", "active": "활동적"},
    "budget": {"low": "저예산", "medium": "중간 예산", "high": "고예산"},
    "companion": {"solo": "혼자", "couple": "커플", "friends": "친구", "family": "가족", "crew": "크루"},
    "environment": {"indoor": "실내", "outdoor": "야외", "mixed": "혼합"},
    "transport": {"walking": "도보", "public_transit": "대중교통", "car": "자동차"},
    "time": {"morning": "아침", "afternoon": "오후", "evening": "저녁", "night": "밤"},
    "mood": {"quiet": "조용함", "lively": "활기참", "romantic": "로맨틱", "local": "로컬"},
    "activity": {"eating": "먹기", "walking": "걷기", "photography": "사진", "hiking": "하이킹", "shopping": "쇼핑"},
}
IDS = tuple(f"{group}:{key}" for group, keys in FEATURES.items() for key in keys)
LABELS = {f"{group}:{key}": label for group, keys in FEATURES.items() for key, label in keys.items()}


def label(feature_id: Column) -> Column:
    """The label of a registered feature; null for any other text."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), feature_id)
