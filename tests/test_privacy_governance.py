from pyspark.sql import functions as F

from crewframe.operators import governance, privacy

SECRET = "unit-test-secret"
TEXT = "Aadhaar 5412 8931 0124, PAN ABCDE1234F, id 784-1990-1234567-1, SSN 123-45-6789, call +1 415-555-2671 or a@b.io"


def test_mask_and_unmask(spark):
    df = spark.createDataFrame(
        [(1, "T1", TEXT), (2, "T1", "again ABCDE1234F and ABCDE1234F"), (3, "T2", "ABCDE1234F"), (4, "T1", "nothing"), (5, "T1", None)],
        "row_id int, tenant_id string, text string",
    )
    masked = privacy.mask_text(df, "text", SECRET)
    rows = {r["row_id"]: r["text"] for r in masked.collect()}
    for kind in ("AADHAAR", "PAN", "EMIRATES_ID", "SSN", "PHONE"):
        assert f"[VAULT_{kind}_" in rows[1]
    assert "a@b.io" in rows[1] and "5412" not in rows[1] and "2671" not in rows[1]
    pan = rows[2].split()[1]
    assert rows[2] == f"again {pan} and {pan}" and pan in rows[1]
    assert rows[3] != pan  # another tenant, another token
    assert rows[4] == "nothing" and rows[5] is None

    vault = privacy.vault(df, "text", SECRET)
    assert {(r["tenant_id"], r["entity_type"], r["original_value"]) for r in vault.collect()} == {
        ("T1", "AADHAAR", "5412 8931 0124"), ("T1", "PAN", "ABCDE1234F"), ("T1", "EMIRATES_ID", "784-1990-1234567-1"),
        ("T1", "SSN", "123-45-6789"), ("T1", "PHONE", "+1 415-555-2671"), ("T2", "PAN", "ABCDE1234F"),
    }
    back = privacy.unmask_text(masked, vault, "text", "row_id")
    assert {r["row_id"]: r["text"] for r in back.collect()} == {r["row_id"]: r["text"] for r in df.collect()}
    # a token of another tenant stays
    foreign = masked.filter("row_id = 3").withColumn("tenant_id", F.lit("T1"))
    assert privacy.unmask_text(foreign, vault, "text", "row_id").collect()[0]["text"] == rows[3]


def test_emails_only_on_request(spark):
    df = spark.createDataFrame([(1, "T", "write to jo.x@site.org.")], ["row_id", "tenant_id", "text"])
    assert privacy.mask_text(df, "text", SECRET).collect()[0]["text"] == "write to jo.x@site.org."
    assert privacy.mask_text(df, "text", SECRET, mask_emails=True).collect()[0]["text"].startswith("write to [VAULT_EMAIL_")


def test_unicode_digits_and_word_edges(spark):
    df = spark.createDataFrame(
        [(1, "T", "x123456789012"), (2, "T", "١٢٣٤ ٥٦٧٨ ٩٠١٢"), (3, "T", "éABCDE1234F")], ["row_id", "tenant_id", "text"]
    )
    rows = {r["row_id"]: r["text"] for r in privacy.mask_text(df, "text", SECRET).collect()}
    assert rows[1].startswith("x[VAULT_AADHAAR_")  # found by the phone pattern, typed by its shape
    assert rows[2].startswith("[VAULT_AADHAAR_")
    assert rows[3] == "éABCDE1234F"  # a letter before it: no word edge


def test_mask_record(spark):
    df = spark.createDataFrame(
        [("T", "E1", "Ann", 5000.0, "ACC-9", "Sales", {"Salary": 1, "note": "PAN ABCDE1234F"}, [{"iban": "X"}], ["ABCDE1234F"], None)],
        "tenant_id string, employee_id string, first_name string, salary double, bank_account string, department string, "
        "extra struct<Salary:int,note:string>, accounts array<struct<iban:string>>, tags array<string>, pan string",
    )
    masked = privacy.mask_record(df, SECRET)
    assert [f.name for f in masked.schema] == [f.name for f in df.schema]
    row = masked.collect()[0]
    assert row["salary"].startswith("[VAULT_SALARY_") and row["bank_account"].startswith("[VAULT_BANK_ACCOUNT_")
    assert (row["first_name"], row["department"], row["tags"], row["pan"]) == ("Ann", "Sales", ["ABCDE1234F"], None)
    assert row["extra"]["Salary"].startswith("[VAULT_SALARY_") and "[VAULT_PAN_" in row["extra"]["note"]
    assert row["accounts"][0]["iban"].startswith("[VAULT_IBAN_")
    stored = {(r["token"], r["original_value"]) for r in privacy.record_vault(df, SECRET).collect()}
    note = row["extra"]["note"].removeprefix("PAN ")
    assert stored == {
        (row["salary"], "5000.0"), (row["bank_account"], "ACC-9"), (row["extra"]["Salary"], "1"), (note, "ABCDE1234F"),
        (row["accounts"][0]["iban"], "X"),
    }


def test_literals(spark):
    df = spark.createDataFrame([(1, "Ana B Pérez", "a@x.io", None)], "row_id int, full_name string, work_email string, phone string")
    literals = privacy.pii_literals(df, "row_id")
    assert sorted(r["literal"] for r in literals.collect()) == ["Ana", "Pérez", "a@x.io"]
    texts = spark.createDataFrame([(1, "hello Ana")], ["row_id", "text"])
    assert [r["literal"] for r in privacy.leaked_literals(literals, texts, "row_id", "text").collect()] == ["Ana"]


def test_authorisation(spark):
    df = spark.createDataFrame(
        [
            ("A1", "HR_ADMIN", "EXECUTE_REMEDIATION", "X"), ("E1", "EMPLOYEE", "MUTATE_SALARY", "X"),
            ("MGR-001", "DEPARTMENT_MANAGER", "APPROVE_LEAVE", "MGR-001"), ("S", "SUPER_ADMIN", "MUTATE_SALARY", "S"),
            ("N", "NOBODY", "VIEW_EMPLOYEE", None), ("M", "DEPARTMENT_MANAGER", "APPROVE_LEAVE", "Y"),
        ],
        "user_id string, role string, permission string, target_employee_id string",
    )
    rows = {r["user_id"]: (r["role_allowed"], r["duty_separated"], r["allowed"]) for r in governance.authorize_actions(df).collect()}
    assert rows == {
        "A1": (True, True, True), "E1": (False, True, False), "MGR-001": (True, False, False),
        "S": (True, False, False), "N": (False, True, False), "M": (True, True, True),
    }
    assert governance.denied_actions(df).count() == 4


def test_idempotency_key(spark):
    df = spark.sql(
        """select * from values
        (1, 'T', 'LEAVE_REQUEST', 'CREATE', 'U', named_struct('b', 1, 'a', named_struct('z', 1, 'y', 2))),
        (2, 'T', 'LEAVE_REQUEST', 'create', 'U', named_struct('b', 1, 'a', named_struct('z', 1, 'y', 2))),
        (3, 'T', 'LEAVE_REQUEST', 'create', 'V', named_struct('b', 1, 'a', named_struct('z', 1, 'y', 2))),
        (4, null, 'LEAVE_REQUEST', 'create', '', named_struct('b', 1, 'a', named_struct('z', 1, 'y', 2)))
        as t(id, tenant_id, entity_type, action, actor_id, payload)"""
    )
    keyed = governance.idempotency_key(df)
    rows = {r["id"]: r["idempotency_key"] for r in keyed.collect()}
    assert rows[1] == rows[2] and len(rows[1]) == 64 and len(set(rows.values())) == 3
    import hashlib

    assert rows[4] == hashlib.sha256(b'default:LEAVE_REQUEST:create:anonymous:{"a":{"y":2,"z":1},"b":1}').hexdigest()


def test_versions(spark):
    updates = spark.createDataFrame(
        [("EMPLOYEE", "1", "v1"), ("EMPLOYEE", "2", "v1"), ("EMPLOYEE", "3", None), ("EMPLOYEE", "4", "v1")],
        "entity_type string, entity_id string, expected_version string",
    )
    current = spark.createDataFrame(
        [("EMPLOYEE", "1", "v1"), ("EMPLOYEE", "2", "v2"), ("EMPLOYEE", "3", "v9"), ("EMPLOYEE", "4", None)],
        "entity_type string, entity_id string, current_version string",
    )
    rows = {r["entity_id"]: r for r in governance.version_conflicts(updates, current).collect()}
    assert [rows[k]["is_conflict"] for k in "1234"] == [False, True, False, True]
    assert rows["2"]["conflict_message"] == (
        "Optimistic concurrency conflict on EMPLOYEE '2': expected version 'v1' but remote is 'v2'."
    )


def test_control_characters_in_texts(spark):
    texts = ["\x03ABCDE1234F\x03", "\x02\x05 ABCDE1234F \x02\x04\x03", "\x02\x03", "a\x03\x02ABCDE1234F", "\x05\x04 784-1990-1234567-1"]
    df = spark.createDataFrame([(i, "T", t) for i, t in enumerate(texts)], "row_id int, tenant_id string, text string")
    one = privacy.mask_text(df, "text", SECRET, found="hits")
    assert one.columns == ["row_id", "tenant_id", "text", "hits"]
    rows = {r["row_id"]: r for r in one.collect()}
    pan = rows[0]["hits"][0]["token"]
    assert [rows[i]["text"] for i in range(4)] == [f"\x03{pan}\x03", f"\x02\x05 {pan} \x02\x04\x03", "\x02\x03", f"a\x03\x02{pan}"]
    back = privacy.unmask_text(one.drop("hits"), privacy.vault_of(one, "hits"), "text", "row_id")
    assert {r["row_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))


def test_texts_and_vault_from_one_scan(spark):
    df = spark.createDataFrame(
        [(1, "T1", TEXT), (2, "T1", "again ABCDE1234F and ABCDE1234F"), (3, "T2", None), (4, "T2", "")], "row_id int, tenant_id string, text string"
    ).withColumn("hits", F.lit("old"))
    one = privacy.mask_text(df, "text", SECRET, mask_emails=True, found="hits")
    assert one.columns == df.columns
    assert sorted(map(tuple, one.drop("hits").collect()), key=str) == sorted(
        map(tuple, privacy.mask_text(df, "text", SECRET, mask_emails=True).drop("hits").collect()), key=str
    )
    assert sorted(privacy.vault_of(one, "hits").collect()) == sorted(privacy.vault(df, "text", SECRET, mask_emails=True).collect())
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("784[ -]?") == 1  # each pattern once


def test_unmask_leaves_what_only_looks_like_a_token(spark):
    vault = spark.createDataFrame([("T", "[VAULT_PAN_" + "A" * 20 + "]", "X")], "tenant_id string, token string, original_value string")
    texts = ["[VAULT_", "[VAULT_PAN_AB]", "[VAULT_PAN_" + "B" * 20 + "]", "a [VAULT_PAN_" + "A" * 20 + "][VAULT_PAN_" + "B" * 20 + "]"]
    df = spark.createDataFrame([(i, "T", t) for i, t in enumerate(texts)], "row_id int, tenant_id string, text string")
    got = {r["row_id"]: r["text"] for r in privacy.unmask_text(df, vault, "text", "row_id").collect()}
    assert got == {0: texts[0], 1: texts[1], 2: texts[2], 3: "a X[VAULT_PAN_" + "B" * 20 + "]"}


def test_updates_of_one_batch_in_order(spark):
    """Two writers that read the same version: the second conflicts.  One entity holds a third of the updates."""
    import random

    rng = random.Random(8)
    rows = []
    for n in range(900):
        entity = "hot" if rng.random() < 0.4 else f"E{rng.randrange(40)}"
        expected = None if rng.random() < 0.1 else f"v{rng.randrange(4)}"
        rows.append(("EMPLOYEE", entity, expected, None if rng.random() < 0.05 else f"v{rng.randrange(4)}", rng.randrange(300), n))
    stored = {f"E{i}": "v1" for i in range(0, 40, 2)} | {"hot": "v0", "unused": "v3"}
    want, state = {}, dict(stored)
    for kind, entity, expected, new, at, n in sorted(rows, key=lambda r: (r[4], r[5])):
        remote = state.get(entity)
        conflict = expected is not None and expected != remote
        text = f"Optimistic concurrency conflict on EMPLOYEE '{entity}': expected version '{expected}' but remote is '{remote}'."
        want[n] = (remote, conflict, text if conflict else None)
        if not conflict:
            state[entity] = new
    shape = "entity_type string, entity_id string, expected_version string, new_version string, at long, n long"
    held = "entity_type string, entity_id string, current_version string"
    current = spark.createDataFrame([("EMPLOYEE", k, v) for k, v in stored.items()], held)
    updates = spark.createDataFrame(rng.sample(rows, len(rows)), shape).repartition(5)
    got = governance.applied_in_order(updates, current, "at", "n").collect()
    assert {r["n"]: (r["remote_version"], r["is_conflict"], r["conflict_message"]) for r in got} == want and len(got) == len(rows)

    twice = spark.createDataFrame([("EMPLOYEE", "A", "v0", "v1", 1, 1), ("EMPLOYEE", "A", "v0", "v2", 2, 2), ("EMPLOYEE", "A", "v1", "v3", 3, 3)], shape)
    base = spark.createDataFrame([("EMPLOYEE", "A", "v0")], held)
    rows = {r["n"]: (r["is_conflict"], r["remote_version"]) for r in governance.applied_in_order(twice, base, "at", "n").collect()}
    assert rows == {1: (False, "v0"), 2: (True, "v1"), 3: (False, "v1")}
    assert governance.applied_in_order(twice.limit(0), base, "at", "n").collect() == []


def test_small_entities_are_walked_and_agree_with_the_jumps(spark, monkeypatch):
    """Entities of few updates take no sort over the cluster; repeated rows, null keys and null places come out alike."""
    import random

    rng = random.Random(5)
    rows = []
    for n in range(400):
        entity = rng.choice([None, "A", "B", *(f"E{i}" for i in range(30))])
        expected = None if rng.random() < 0.2 else f"v{rng.randrange(3)}"
        at = None if rng.random() < 0.1 else rng.randrange(40)
        rows.append((None if rng.random() < 0.05 else "EMPLOYEE", entity, expected, rng.choice([None, "v0", "v1", "v2"]), at, n))
    rows += rng.sample(rows, 60)
    rows.append(("EMPLOYEE", "A", "v0", "v1", None, None))
    shape = "entity_type string, entity_id string, expected_version string, new_version string, at long, n long"
    updates = spark.createDataFrame(rows, shape).repartition(3)
    held = [("EMPLOYEE", "A", "v0"), ("EMPLOYEE", None, "v0"), *(("EMPLOYEE", f"E{i}", "v1") for i in range(0, 30, 2))]
    current = spark.createDataFrame(held, "entity_type string, entity_id string, current_version string")

    def found():
        return sorted((tuple(r) for r in governance.applied_in_order(updates, current, "at", "n").collect()), key=repr)

    monkeypatch.setattr(governance, "WALKED", 0)
    jumped = found()
    monkeypatch.setattr(governance, "WALKED", 20)
    assert found() == jumped
    monkeypatch.undo()

    def sorts(*_, **__):
        raise AssertionError("sorted over the cluster")

    monkeypatch.setattr(governance, "nearest_marks", sorts)
    assert found() == jumped and len(jumped) == len(rows) - 1


def test_keys_sorted_in_the_plan_and_by_variant_agree(spark):
    shape = "struct<b:string,a:struct<z:bigint,y:array<struct<k:int,j:string>>>,n:string,flag:boolean>"
    df = spark.sql(
        f"""SELECT cast(named_struct('b', 'x "q" ü', 'a', named_struct('z', 5L, 'y', array(named_struct('k', 1, 'j', 'p'), null)),
        'n', null, 'flag', true) as {shape}) AS payload UNION ALL SELECT cast(null as {shape})"""
    )
    kind = df.schema["payload"].dataType
    rows = df.select(governance.canonical_json(F.col("payload"), kind).alias("a"), governance.canonical_json(F.col("payload")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[0]["a"].startswith('{"a":{"y":[{"j":"p","k":1},null],"z":5},"b":')
    plan = df.select(governance.canonical_json(F.col("payload"), kind))._jdf.queryExecution().optimizedPlan().toString()
    assert "parse" not in plan.lower()
    money = spark.sql("SELECT named_struct('b', cast(10.00 as decimal(9,2)), 'a', 1) AS payload")
    assert governance.canonical_json(F.col("payload"), money.schema["payload"].dataType) is not None
    assert money.select(governance.canonical_json(F.col("payload"), money.schema["payload"].dataType)).first()[0] == '{"a":1,"b":10}'
