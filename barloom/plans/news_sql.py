"""SQL of headlines: their classes, and the score per symbol."""

from __future__ import annotations

from barloom.operators import news


def any_of(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def case_of(sets: dict[str, list[str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(words)} THEN '{name}'" for name, words in sets.items()) + f" ELSE '{other}' END"


def count_of(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ")"


NEWS = f"""SELECT *, {case_of(news.CATEGORIES, 'Corporate')} AS category, {case_of(news.IMPACT, 'LOW')} AS impact,
  CASE WHEN plus > minus THEN 'POSITIVE' WHEN minus > plus THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment FROM (
  SELECT *, {count_of(news.POSITIVE)} AS plus, {count_of(news.NEGATIVE)} AS minus FROM (SELECT *, lower(title) AS t FROM (
    SELECT * REPLACE (CASE WHEN len(p) > 1 THEN trim(array_to_string(p[1:len(p) - 1], ' - ')) ELSE title END AS title,
      CASE WHEN len(p) > 1 THEN coalesce(nullif(trim(p[len(p)]), ''), source) ELSE source END AS source) FROM (SELECT *, string_split(title, ' - ') AS p FROM headlines))))"""
TOLD = f"""SELECT symbol, score, news, headline, label, CASE WHEN score >= 25 THEN 'VERY_BULLISH' WHEN score >= 8 THEN 'BULLISH' WHEN score <= -25 THEN 'VERY_BEARISH' WHEN score <= -8 THEN 'BEARISH' ELSE 'NEUTRAL' END AS level,
        CASE WHEN abs(score) >= 35 THEN 'CRITICAL' WHEN abs(score) >= 20 THEN 'HIGH' WHEN abs(score) >= 10 THEN 'MEDIUM' WHEN abs(score) > 0 THEN 'LOW' ELSE 'NONE' END AS severity, {case_of(news.EVENTS, 'GENERAL')} AS event FROM (
        SELECT *, lower(coalesce(headline, '')) AS t, CASE WHEN score >= 4 THEN 'BULLISH' WHEN score <= -4 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM (
        SELECT u.symbol, greatest(-20, least(20, coalesce(sum(CASE WHEN m.direct THEN CASE impact WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 5 ELSE 3 END ELSE CASE WHEN impact = 'HIGH' THEN 3 ELSE 2 END END
          * CASE sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END), 0)))::BIGINT AS score, count(m.id) AS news, arg_min(m.title, m.id) AS headline
        FROM named u LEFT JOIN (SELECT u.symbol AS sym, n.*, contains(n.t, lower(u.symbol)) OR contains(n.t, string_split(u.name, ' ')[1]) AS direct FROM news n JOIN named u
          ON contains(n.t, lower(u.symbol)) OR (length(string_split(u.name, ' ')[1]) >= 4 AND contains(n.t, string_split(u.name, ' ')[1])) OR contains(n.t, lower(u.sector))) m ON m.sym = u.symbol GROUP BY u.symbol))"""
