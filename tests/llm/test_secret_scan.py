import hashlib
import re
import time

import pytest

from tableprobe.llm.queries import QUERIES
from tableprobe.llm.secret_scan import find_secrets, redact_secrets, scan_secrets
from tests.llm import cases


def base(text):
    found = []
    for m in re.finditer(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


@pytest.mark.parametrize("text, secrets", [
    ('a = "Zk3v9Qw8Lm2x"\nb = a\ndb_password = b\n', ["Zk3v9Qw8Lm2x"]),  # through two names
    ("pwd = later\nlater = 'T0pS3cretV4lue'", ["T0pS3cretV4lue"]),  # the name comes first
    ('{"client_secret": "9f8A7B6c5D4e3F2a1b"}', ["9f8A7B6c5D4e3F2a1b"]),
    ("export DB_PASS=hunter2Hunter9\n", ["hunter2Hunter9"]),
    ("password: str = 'S3cr3tP4ssw0rd!'", ["S3cr3tP4ssw0rd!"]),
    ("part = 'Xyz123456789Q'\nAPI_KEY := 'Abc9' + part", ["Xyz123456789Q"]),
    ("token_count = 123456789012", []), ("The secret: that thing is nothing.", []), ("password = 'example-password-1'", []),
    ("a == 'Zk3v9Qw8Lm2x'", []), ("color = 'Zk3v9Qw8Lm2x'", []), ("=:=:=", []), ("password =", []), ("", []),
])
def test_literals_that_reach_sensitive_names(text, secrets):
    assert [text[s.start:s.end] for s in find_secrets(text) if s.kind == "literal"] == secrets


@pytest.mark.parametrize("value, secret", [
    ("aB3<kL9pQ2xZ7w!m", True), ("aB3xXXxkL9pQ2Z7w", True), ("Zk3v9sampleQw8Lm2xP", True), ("q000000Zk3v9Qw8Lm2x", True),
    ("correct horse battery staple", True), ("<your password>", False), ("${DB_PASSWORD_1}", False), ("{{ vault_pw_12 }}", False),
    ("xxxxxxxxxxxx", False), ("************", False), ("your_api_key_here_123", False), ("Please enter your password", False),
])
def test_stand_ins_and_phrases(value, secret):
    text = f"db_password = '{value}'"
    assert [text[s.start:s.end] for s in find_secrets(text) if s.kind == "literal"] == [value] * secret


@pytest.mark.parametrize("text, secrets", [
    ("BOT_TOKEN=123456789:AAHdqTcvZ8w\n", ["123456789:AAHdqTcvZ8w"]), ("DB_PASSWORD=Xy9&kLm2pQ7vT4zR", ["Xy9&kLm2pQ7vT4zR"]),
    ("AUTH=postgres://app:Zk3vQ9w2@db", ["postgres://app:Zk3vQ9w2@db"]), ("secret: Zk3v=Qw8Lm2x9pT", ["Zk3v=Qw8Lm2x9pT"]),
    ("url=http://h/?password=Zk3v9Qw8Lm2x&user=bob", ["Zk3v9Qw8Lm2x"]), ("password:string='Zk3v9Qw8Lm2x'", ["Zk3v9Qw8Lm2x"]),
    ("x=env:DB_PASSWORD=Xy9&kLm2pQ7vT4zR", ["Xy9&kLm2pQ7vT4zR"]),
])
def test_unquoted_values_are_taken_whole(text, secrets):
    assert [text[s.start:s.end] for s in find_secrets(text) if s.kind == "literal"] == secrets


A, B = "Zk3v9Qw8Lm2x", "Qk3v9Qw8Lm2y"


@pytest.mark.parametrize("text, secrets", [
    (f'PASSWORD = ("{A}")', [A]), (f'API_TOKENS = ["{A}",\n  "{B}"]', [A, B]), (f"tokens: [{A}, {B}]", [A, B]),
    (f'password = String("{A}")', [A]), (f'PASSWORD = os.getenv("DB_PASSWORD_1", "{A}")', [A]),
    (f'PASSWORD = """{A}"""', [A]), (f'PASSWORD = """\n{A}\n"""\n', [A]), (f"PASSWORD = \\\n  '{A}'", [A]),
    (f"password: |\n  {A}\nuser: bob\n", [A]), (f"password:\n  {A}\nuser: bob\n", [A]),
    (f"tokens:\n  - {A}\n  - {B}\n", [A, B]), (f'String password =\n    "{A}";', [A]),
    (f'c = connect(host="h", password="{A}" + "{B}")', [A, B]), (f'conf = """\npassword = "{A}"\n"""', [A]),
    ('password = os.environ["DB_PASSWORD_2"]', []), ("secrets:\n  db_config1_name: foo\n", []),
    (f"PASSWORD=\nexport FOO={A}\n", []),
])
def test_values_in_brackets_calls_and_on_further_lines(text, secrets):
    assert [text[s.start:s.end] for s in find_secrets(text) if s.kind == "literal"] == secrets


@pytest.mark.parametrize("text, secrets", [
    (f'cfg["db_password"] = "{A}"', [A]), (f"os.environ['DB_PASSWORD'] = '{A}'", [A]), (f'["password"] = "{A}",', [A]),
    (f'password, user = "{A}", "bob"', [A]), (f"user, api_key = name, '{A}'\n", [A]),
    (f"config.set('password', '{A}')", [A]), (f'os.environ.setdefault("DB_PASSWORD", "{A}")', [A]),
    (f'pairs = [("api_token", "{A}"), ("user", "{B}")]', [A]), (f"<password>{A}</password>", [A]),
    (f'<db_password type="x">{A}</db_password>', [A]), (f'<add key="ApiKey" value="{A}"/>', [A]),
    (f'<property name="secret.token">{A}</property>', [A]), (f'<add key="Colour" value="{A}"/>', []),
    (f'#define DB_PASSWORD "{A}"', [A]), (f"  # define API_TOKEN {A}\n", [A]), (f'#define COLOUR "{A}"', []),
    (f"Authorization: Bearer {A}", [A]), (f'"Authorization": "Basic {A}=="', [A + "=="]),
    (f"DATABASE_URL=postgres://user:{A}@host/db", [A]), (f"see https://bob:{A}@example.org.", [A]),
    ('a = "Zk3v9Qw"; b = "8Lm2xT7"; password = a + b', ["Zk3v9Qw", "8Lm2xT7"]),
    ("c = 'Zk3v9Qw'\nd = c\npassword = d + '8Lm2xT7'\n", ["Zk3v9Qw", "8Lm2xT7"]),
    ("a = 'abc'; b = 'def'; password = a + b", []), ("tokens = ['id-1', 'id-2', 'id-3']", []),
    (f"private_key: |\n  -----BEGIN RSA PRIVATE KEY-----\n  {A}{B}\n  -----END RSA PRIVATE KEY-----\n", [A + B]),
])
def test_other_forms_and_folded_constants(spark, text, secrets):
    found = find_secrets(text)
    assert sorted({text[s.start:s.end] for s in found if s.kind == "literal"} - {f"postgres://user:{A}@host/db"}) == sorted(secrets)
    row = redact_secrets(spark.createDataFrame([(text,)], "text string").coalesce(1)).first()["text"]
    assert all(secret not in row for secret in secrets) and (not secrets or "[secret]" in row)


@pytest.mark.parametrize("text", [
    "<a " * 150_000, "<a>b</" * 80_000, "('a'," * 100_000, "('a', 'b" * 60_000, "://a:" * 100_000, "#define a " * 50_000, "a," * 250_000 + "b=",
    "a, b = c, d\n" * 40_000, "password = a + b\na = b\nb = a\n" * 10_000, "key='a' value " * 40_000, "authorization: bearer " * 25_000,
    "x1 = x0\n" + "".join(f"x{i} = x{i - 1}\npassword = x{i} + x{i}\n" for i in range(2, 15_000)), "<a name='b' " * 40_000, "a['b']=" * 60_000,
])
def test_time_grows_with_other_forms(text):
    test_time_grows_with_the_text(text)


@pytest.mark.parametrize("text", [
    f'"{"n" * 90}_password": "{A}"', f"{'n' * 200}_const = '{A}'\ndb_password = {'n' * 200}_const\n",
    f"password{' ' * 300}= '{A}'", f"pass{'.n' * 60}: str = '{A}'",
])
def test_names_of_any_length(text):
    assert [text[s.start:s.end] for s in find_secrets(text) if s.kind == "literal"] == [A]


@pytest.mark.parametrize("text", ["a[" * 250_000 + "=b", "a: " * 150_000, "x'=" * 150_000, "ab:" + "c" * 400_000 + "=d"])
def test_time_grows_with_names(text):
    test_time_grows_with_the_text(text)


@pytest.mark.parametrize("text", ["token=[" * 100_000, "x=(''" + "\\'" * 200_000, "token: |\n " * 50_000, 'token=\"""a' * 50_000,
                                  "x=f('token=a:" * 50_000])
def test_time_grows_with_brackets_and_lines(text):
    test_time_grows_with_the_text(text)


@pytest.mark.parametrize("text", ["token=token:" * 50_000, "a=b + " * 100_000, "?token=a" * 50_000, "x=?token=a&" * 50_000])
def test_time_grows_with_joined_values(text):
    test_time_grows_with_the_text(text)


@pytest.mark.parametrize("text", ["a=b:" * 100_000, "token = token\n" * 50_000, "x='" * 50_001, "a" * 500_000 + "=b", "=" * 500_000])
def test_time_grows_with_the_text(text):
    start = time.process_time()
    find_secrets(text)
    assert time.process_time() - start < 20


def test_base_patterns_as_given():
    values = ["TOKEN='abc' token=abcdefghijkl", "ſecret=abcdefghijklm", "apiKey : \"a1b2c3d4e5f6\"", "AKIA" * 6, "é" * 3 + "ab" * 9,
              "password=short password=longenough123", "x" * 20 + "0123456789ABCDEF"]
    for value in values:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in find_secrets(value) if s.kind != "literal"] == base(value)


def test_rows(spark):
    df = cases.frame(spark).withColumnRenamed("score", "secrets")
    found = scan_secrets(df)
    assert found.columns == [c for c in df.columns if c != "secrets"] + ["secrets"]
    for r in found.collect():
        assert [s["kind"] for s in r["secrets"]] == [s.kind for s in find_secrets(r["text"] or "")]
    clean = {(r["doc_id"], r["text"]) for r in redact_secrets(df).collect()}
    assert (19, 'password = "[secret]"\nkey = [secret]') in clean or (19, '[secret]"\nkey = [secret]') in clean
    assert (20, "[secret]") in clean and (1, None) in clean and (2, "") in clean
    assert scan_secrets(cases.frame(spark, [])).count() == 0


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{cases.SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op5_secrets"](spark, cases.SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(expected)
        assert set(expected) <= set(r["spans"].split(",")) | {""}
