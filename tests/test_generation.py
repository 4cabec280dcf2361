from textcoder.operators.generation import apply_fallback, build_prompts, generate, parse_response


def _parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    rows = df.select("i", parse_response("response").alias("p")).collect()
    return [r["p"] for r in sorted(rows, key=lambda r: r["i"])]


def test_response_rules(spark):
    texts = [
        '{"nace_code": "01.11", "codable": true, "confidence": 0.8}',
        '{"nace_code": null, "codable": false, "confidence": 0}',
        '{"codable": true, "confidence": 0.5}',
        '{"nace_code": "x", "codable": true, "confidence": -0.1}',
        '{"nace_code": "x", "codable": true, "confidence": 1}',
        '{"nace_code": "x", "codable": true, "confidence": 1.5}',
        '{"nace_code": "x", "codable": true, "confidence": "0.5"}',
        '{"nace_code": "x", "codable": "true", "confidence": 0.5}',
        'not json',
        '```json\n{"nace_code": "x", "codable": true, "confidence": 0.5}\n```',
        '{"nace_code": "x", "codable": true, "confidence": 0.5} trailing',
        None,
        '{"nace_code": "x", "codable": "maybe", "confidence": 0.5}',
    ]
    p = _parse(spark, texts)
    assert p[0]["error"] is None and p[0]["nace_code"] == "01.11" and p[0]["confidence"] == 0.8
    assert p[1]["error"] is None and p[1]["nace_code"] is None and p[1]["codable"] is False
    assert p[2]["error"] == "missing key: nace_code"
    assert p[3]["error"] == "confidence out of range"
    assert p[4]["error"] is None
    assert p[5]["error"] == "confidence out of range"
    assert p[6]["error"] is None and p[6]["confidence"] == 0.5
    assert p[7]["error"] is None and p[7]["codable"] is True
    assert p[8]["error"] == "not a JSON object"
    assert p[9]["error"] == "not a JSON object"
    assert p[10]["error"] == "not a JSON object"
    assert p[11]["error"] == "no response"
    assert p[12]["error"] == "codable is not a boolean"


def test_fallback_keeps_or_drops_candidates(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "oops")], "i int, codes array<string>, response string")
    parsed = df.withColumn("parsed", parse_response("response"))
    ours = apply_fallback(parsed).first()
    ref = apply_fallback(parsed, reference_fallback=True).first()
    assert ours["pred_code"] is None and ours["confidence"] == 0.0 and ours["retrieved_codes"] == ["a", "b"]
    assert ref["retrieved_codes"] == [] and ref["codable"] is False


def test_prompt_lists_in_rank_order(spark):
    df = spark.createDataFrame([("make bread", ["10.71", "10.72"], ["# Code: 10.71", "# Code: 10.72"])],
                               "a string, codes array<string>, texts array<string>")
    r = build_prompts(df, "a").first()
    assert r["codes_list"] == "10.71, 10.72"
    assert "## # Code: 10.71\n\n## # Code: 10.72" in r["user"]
    assert "make bread" in r["user"]


def test_template_slots_inside_values_stay_text(spark):
    df = spark.createDataFrame([("bake {codes}", ["t {activity}"], ["{descriptions}"])],
                               "act string, texts array<string>, codes array<string>")
    user = build_prompts(df, "act").first()["user"]
    assert "Activity to code: bake {codes}" in user and "t {activity}" in user
    assert user.endswith("Candidate codes: {descriptions}")


def test_one_bad_row_costs_one_answer(spark):
    def generator(systems, users):
        if "bad" in users:
            raise ValueError("no answer")
        return [u.upper() for u in users]

    df = spark.createDataFrame([("s", "ok1"), ("s", "bad"), ("s", "ok2")], "system string, user string")
    got = {r["user"]: (r["response"], r["gen_error"]) for r in generate(df.coalesce(1), generator).collect()}
    assert got == {"ok1": ("OK1", None), "bad": (None, "ValueError: no answer"), "ok2": ("OK2", None)}
