"""Taxonomy of disclosure titles: rules that compile into one CASE expression."""

from __future__ import annotations

# Categories in order of precedence, the direction rule of each, and the patterns that pick it.
# The titles to be classified are Russian, and the results must be the same as with these very patterns.
CATEGORIES: list[tuple[str, str, list[str]]] = [
    ("insider_stake_change", "stake_change", [
        r"изменени\S* размера доли участия .*орган\S* управлени",
        r"изменени\S* размера доли участия член\S* органа управления",
        r"изменени\S* доли участия лиц, входящих в состав органов управления",
        r"изменени\S* размера доли участия .*лиц\S*, входящ",
    ]),
    ("insider_transactions", "neutral", [
        r"инсайдер",
    ]),
    ("buyback", "positive", [
        r"приобретени\S* эмитентом (собственных )?(акций|ценных бумаг)",
        r"выкуп\S* .*акци",
        r"об увеличении доли эмитента",
    ]),
    ("dividends_recommendation", "neutral", [
        r"рекомендац\S* .*дивиденд",
        r"дивиденд\S* .*рекомендац",
    ]),
    ("dividends_decision", "neutral", [
        r"начисленных .*доходах",
        r"выплат\S* .*дивиденд",
        r"объявленных .*дивиденд",
        r"о выплаченных доходах",
        r"дивиденд",
    ]),
    ("major_holder_change", "neutral", [
        r"приобретени\S* лицом (голосующих )?акци",
        r"изменени\S* доли .*(лиц|акционер).*(голос|распоряжа)",
        r"лиц\S*, (имеющ|получивш)\S* право распоряжаться .*голос",
        r"изменени\S* размера доли .*акционер",
        r"об изменении доли участия .*акционера",
    ]),
    ("controlling_person", "neutral", [
        r"контролирующ\S* лиц",
        r"подконтрольн\S* .*(появлен|прекращен)",
    ]),
    ("board_agenda", "neutral", [
        r"заседани\S* совета директоров .*повестк",
        r"о проведении заседания совета директоров",
        r"созыв\S* заседани\S* совета директоров",
    ]),
    ("board_decisions", "neutral", [
        r"решени\S*, принят\S* советом директоров",
        r"отдельных решениях",
        r"решени\S* совета директоров",
    ]),
    ("agm_call", "neutral", [
        r"созыв\S* .*общего собрания",
        r"о созыве",
        r"дат\S* .*общего собрания",
    ]),
    ("agm_results", "neutral", [
        r"проведении общего собрания .*принятых им решени",
        r"решени\S* общ\S* собрани",
        r"итог\S* .*общего собрания",
    ]),
    ("material_transaction", "neutral", [
        r"существенн\S* сделк",
        r"крупн\S* сделк",
    ]),
    ("related_party_transaction", "neutral", [
        r"заинтересованност",
    ]),
    ("financial_statements", "neutral", [
        r"консолидированн\S* финансов\S* отчетност",
        r"бухгалтерск\S* .*отчетност",
        r"отчет\S* эмитента",
        r"годов\S* отчет",
        r"ежеквартальн\S* отчет",
        r"промежуточн\S* .*отчетност",
        r"финансов\S* отчетност",
    ]),
    ("rating", "neutral", [
        r"рейтинг",
    ]),
    ("listing", "neutral", [
        r"делистинг",
        r"включени\S* .*в (список|котировальн)",
        r"исключени\S* .*из (списка|котировальн)",
        r"изменени\S* .*уровн\S* .*списк",
        r"листинг",
    ]),
    ("default_or_debt", "negative", [
        r"неисполнени\S* .*обязательств",
        r"дефолт",
        r"просрочк",
        r"техническ\S* дефолт",
    ]),
    ("bonds", "neutral", [
        r"облигаци",
        r"купон",
        r"оферт",
        r"погашени\S* .*ценных бумаг",
        r"биржевых облигац",
    ]),
    ("share_issue", "neutral", [
        r"дополнительн\S* выпуск",
        r"размещени\S* .*(акци|ценных бумаг)",
        r"этап\S* .*эмисси",
        r"государственн\S* регистраци\S* .*выпуск",
        r"решени\S* о выпуске",
    ]),
    ("reorganization_ma", "neutral", [
        r"реорганизац",
        r"присоединени",
        r"слияни",
        r"приобретени\S* .*(доли|акций) .*(организац|обществ)",
        r"получени\S* .*права распоряжаться .*подконтрольн",
    ]),
    ("management_change", "neutral", [
        r"состав\S* .*органов управления",
        r"единоличн\S* исполнительн\S* орган",
        r"избрани\S* .*(генерального директора|президента|председателя)",
        r"прекращени\S* полномочий",
    ]),
    ("significant_other", "neutral", [
        r"иных событиях",
        r"существенн\S* влияни\S* на стоимость",
        r"могут оказать существенное влияние",
        r"оказывающ\S*, по мнению эмитента",
    ]),
    ("correction", "neutral", [
        r"корректировк",
        r"изменении или корректировке",
        r"ранее опубликованн",
    ]),
    ("affiliated_list", "neutral", [
        r"аффилированн",
    ]),
    ("other", "neutral", [
    ]),
]
